"""Small documents with every odd case: nulls, empty and long texts, copies, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, copies int, node string"


def docs(spark, n=60, seed=1, long=20_000):
    r = random.Random(seed)
    words = ["the", "and", "thing", "édition", "über", "ou", "naïve", "日本", "x1", "ing.", "of,", "Re", "a"] + ["".join(r.choice("abcdeor") for _ in range(r.randint(3, 9))) for _ in range(150)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = line(40)
    rows = []
    for i in range(n):
        text = "\n".join(line(r.randint(3, 25)) for _ in range(r.randint(1, 8)))
        if i % 5 == 1:
            text = text + "\n" + passage
        if i % 7 == 3 and rows and rows[-1][1]:
            text = rows[-1][1] if i % 2 else rows[-1][1] + " tail"
        rows.append([i, text])
    rows[4][1], rows[5][1], rows[6][1], rows[8][1] = None, "", "  \n\t ", "one"
    rows[9][1] = (line(30) + "\n") * 3 + "z" * long
    rows.append([10, rows[10][1]])  # a repeated row
    rows.append([11, rows[12][1]])  # a repeated id with another text
    rows.append([None, passage + " end"])
    rows.append([None, None])
    sources = ["hot"] * 3 + ["a", "b", None, ""]
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], len(t or ""), "x", 7, "y") for k, (i, t) in enumerate(rows)], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]
