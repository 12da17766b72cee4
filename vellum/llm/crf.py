"""A two-label linear-chain conditional random field over the lines of documents, in NumPy.

``Lines`` computes the features of all lines of a batch of texts at once: the texts lie in one byte buffer, classes of
bytes come from tables, words and lines are numbered by their bytes, so what counts as equal is equal.
"""

from __future__ import annotations

import numpy as np

#: Labels of a line.
BOILERPLATE, CONTENT = 0, 1
FEATURES = ["bias", "log_words", "symbols", "pipes", "punctuated", "digits", "capitals", "ends_sentence", "repeats_previous", "duplicate", "short_words", "word_length", "starts_capital", "repeated_windows"]
SYMBOLS = b"#*$%&|<>"


def _mask(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


IS_SPACE = _mask(b" \t\n\x0b\x0c\r")
IS_SYMBOL = _mask(SYMBOLS)
IS_DIGIT = _mask(b"0123456789")
IS_UPPER = _mask(bytes(range(65, 91)))
ENDS_CLAUSE = _mask(b".,;:!?")
ENDS_SENTENCE = _mask(b".!?")
IS_START = np.array([b & 0xC0 != 0x80 for b in range(256)])


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def numbers(things: list[bytes]) -> np.ndarray:
    """Equal things have equal numbers, below the count of things."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(x, len(known)) for x in things], np.int64)


def twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key stands more than once."""
    order = np.argsort(keys)
    k = keys[order]
    eq = k[1:] == k[:-1]
    same = np.zeros(len(keys), bool)
    same[order[1:]] |= eq
    same[order[:-1]] |= eq
    return same


class Lines:
    """Counts of a batch of texts (UTF-8 bytes) and the features of their lines that hold a word."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # every text ends with a newline of its own
        n_docs = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        begins = np.concatenate(([0], ends))[:n_docs]
        space = IS_SPACE[buf]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        word = numbers([w for t in texts for w in t.split()])
        word_doc = np.searchsorted(ends, starts, side="right")
        line_ends = np.flatnonzero(buf == 10)
        line_begins = np.concatenate(([0], line_ends + 1))[: len(line_ends)]
        word_line = np.searchsorted(line_ends, starts, side="left")
        line_words = np.bincount(word_line, minlength=len(line_ends))
        with_word = np.flatnonzero(line_words)
        line_doc = np.searchsorted(ends, line_begins, side="right")

        per_doc = lambda docs, weights=None: np.bincount(docs, weights, minlength=n_docs).astype(np.int64)
        self.n_words = per_doc(word_doc)
        count = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        symbols, word_chars = count(IS_SYMBOL[buf]), count(IS_START[buf] & ~space)
        self.n_symbols = symbols[ends] - symbols[begins]
        self.word_chars = word_chars[ends] - word_chars[begins]
        line = numbers([x for t in texts for x in t.split(b"\n")])[with_word]
        duplicate = seen_before(line_doc[with_word] * len(line_ends) + line)
        self.n_dup_lines = per_doc(line_doc[with_word], duplicate)

        covered = np.zeros(len(word), bool)
        if len(word) > 2:
            one_doc = word_doc[2:] == word_doc[:-2]
            size = len(word)  # products stay below 2 ** 63 up to three thousand million words
            pair = np.unique(word[:-1] * size + word[1:], return_inverse=True)[1]
            triple = np.unique(pair[:-1] * size + word[2:], return_inverse=True)[1]
            window = word_doc[:-2] * size + triple
            again = np.zeros(len(word) - 2, bool)
            again[one_doc] = twice(window[one_doc])
            covered[:-2] |= again
            covered[1:-1] |= again
            covered[2:] |= again
        self.n_repeat_words = per_doc(word_doc, covered)

        per_line = lambda x: np.bincount(word_line, x, minlength=len(line_ends))[with_word]
        w = line_words[with_word].astype(float)
        lb, le = line_begins[with_word], line_ends[with_word]
        chars = np.maximum(word_chars[le] - word_chars[lb], 1)
        share = lambda sums: (sums[le] - sums[lb]) / chars
        lengths = stops - starts
        last_word = np.searchsorted(starts, le, side="left") - 1
        first_word = np.searchsorted(starts, lb, side="left")
        previous = np.zeros(len(word), bool)
        previous[1:] = (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1])
        bare_pipe = (lengths == 1) & (buf[starts] == ord("|"))
        self.x = np.stack([
            np.ones(len(w)), np.log1p(w) / 3, share(symbols), per_line(bare_pipe) / w, per_line(ENDS_CLAUSE[buf[stops - 1]]) / w, share(count(IS_DIGIT[buf])), share(count(IS_UPPER[buf])),
            ENDS_SENTENCE[buf[stops[last_word] - 1]].astype(float), per_line(previous) / w, duplicate.astype(float), per_line(lengths <= 3) / w,
            np.minimum(per_line(lengths) / w / 10, 5), IS_UPPER[buf[starts[first_word]]].astype(float), per_line(covered) / w,
        ], axis=1) if len(w) else np.zeros((0, len(FEATURES)))
        self.line_words = line_words[with_word]
        self.line_doc = line_doc[with_word]
        self.line_number = with_word - np.searchsorted(line_begins, begins[self.line_doc], side="left") if len(w) else with_word
        self.n_docs = n_docs

    def lengths(self) -> np.ndarray:
        """Lines with a word per text."""
        return np.bincount(self.line_doc, minlength=self.n_docs)


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, where their lines begin, and the number of documents longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return order, begins, active


def viterbi(x: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """The best label of each line; all documents advance together."""
    state, trans = np.asarray(model["state"]), np.asarray(model["transition"])
    score = x @ state.T
    _, begins, active = _layout(lengths)
    back = np.zeros((len(x), 2), np.uint8)
    labels = np.zeros(len(x), np.uint8)
    best = np.zeros((len(begins), 2))
    for t, a in enumerate(active):
        here = begins[:a] + t
        if t:
            step = best[:a, :, None] + trans
            back[here] = step.argmax(1)
            best[:a] = step.max(1)
        best[:a] += score[here]
    current = best.argmax(1).astype(np.uint8)
    for t in range(len(active) - 1, -1, -1):
        here = begins[: active[t]] + t
        labels[here] = current[: active[t]]
        current[: active[t]] = back[here, current[: active[t]]]
    return labels


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis)
    return m + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))


def train(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.2, l2: float = 0.05) -> dict:
    """Maximise the conditional likelihood of the label sequences by Adam on the exact gradient (forward-backward)."""
    n, k = x.shape
    mean, std = x.mean(0), x.std(0) + 1e-6
    mean[0], std[0] = 0.0, 1.0
    z = (x - mean) / std
    theta = np.zeros(2 * k + 4)
    m = v = np.zeros_like(theta)
    _, begins, active = _layout(lengths)
    docs = max(int((lengths > 0).sum()), 1)
    gold = np.zeros((n, 2))
    gold[np.arange(n), y] = 1
    for step in range(1, steps + 1):
        state, trans = theta[: 2 * k].reshape(2, k), theta[2 * k :].reshape(2, 2)
        score = z @ state.T
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t, a in enumerate(active):
            here = begins[:a] + t
            alpha[here] = score[here] + (_lse(alpha[here - 1][:, :, None] + trans, 1) if t else 0)
        for t in range(len(active) - 2, -1, -1):
            here = begins[: active[t + 1]] + t
            beta[here] = _lse(trans[None] + (score[here + 1] + beta[here + 1])[:, None, :], 2)
        both = alpha + beta
        total = _lse(both, 1)
        p = np.exp(both - total[:, None])
        grad_trans = np.zeros((2, 2))
        for t in range(1, len(active)):
            here = begins[: active[t]] + t
            pair = np.exp(alpha[here - 1][:, :, None] + trans + (score[here] + beta[here])[:, None, :] - total[here][:, None, None])
            grad_trans += (gold[here - 1][:, :, None] * gold[here][:, None, :] - pair).sum(0)
        grad = np.concatenate((((gold - p).T @ z).ravel(), grad_trans.ravel())) / docs - l2 * theta / docs
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    state = theta[: 2 * k].reshape(2, k) / std
    state[:, 0] -= (state * mean).sum(1)
    return {"state": state.tolist(), "transition": theta[2 * k :].reshape(2, 2).tolist()}
