"""Chunking: oversized units are split by their kind, packed into children under a token budget, and linked.

A section is a parent. Splitting works unit by unit; packing minimises, for each cut in turn, the similarity across the
cut, the distance from the target length and a penalty for cutting a group. Both are folds over one section, so a task
holds one section; prefixes, ids, links and parents are expressions and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.config import ChunkConfig, SemanticConfig
from vellum.functions import code, fixed, rules, vectors
from vellum.functions import text as T
from vellum.operators.folds import by_group, late
from vellum.operators.structure import _hash

PIECE = "unit_id string, original_unit_id string, kind string, text string, page_start int, page_end int, group_id string, split_strategy string, break_before boolean, break_after boolean, signature string"
CHILD = (
    "document_id string, section_id string, parent_id string, chunk_index int, child_id string, text string, page_start int, page_end int, heading_path array<string>, unit_ids array<string>, overlap_unit_ids array<string>, "
    "unit_count int"
)
EXPANDED = f"document_id string, section_id string, piece_seq int, heading_path array<string>, {PIECE}"
#: Similarity that stands for "no cut here" behind the last item.
NO_CUT = 0.15


def similarities(texts: Sequence[str], encode: Callable) -> list[float]:
    """Inner products of neighbouring vectors."""
    v = encode(list(texts)) if len(texts) > 1 else []
    return np.einsum("ij,ij->i", v[:-1], v[1:]).astype(float).tolist() if len(v) > 1 else []


def neighbours(texts: Sequence[str], sizes: Sequence[int], target: int, encode: Callable) -> list[float]:
    """What :func:`partition` needs of :func:`similarities`: nothing where all is one range."""
    return similarities(texts, encode) if sum(sizes) > target else []


def partition(sizes: Sequence[int], near: Sequence[float], groups: Sequence[str | None], low: int, target: int, high: int, config: ChunkConfig, penalty: float | None = None) -> list[tuple[int, int]]:
    """Ranges of items. Every range is cut where similarity, length and group cost least among the cuts that lie between
    ``low`` and ``high`` tokens; what is left is one range once it fits the target."""
    total = np.concatenate(([0], np.cumsum(sizes))).astype(int)
    n, start, out = len(sizes), 0, []
    penalty = config.same_group_break_penalty if penalty is None else penalty
    while start < n:
        if total[n] - total[start] <= target or n - start == 1:
            out.append((start, n))
            break
        cuts = []
        for cut in range(start + 1, n + 1):
            length = int(total[cut] - total[start])
            if length > high:
                break
            if length >= low:
                split = cut < n and bool(groups[cut - 1]) and groups[cut - 1] == groups[cut]
                off = abs(length - target)
                cost = (near[cut - 1] if cut < n else NO_CUT) * config.semantic_weight + off / max(target, 1) * config.length_weight + penalty * split
                cuts.append((cost, off, cut))
        most = config.boundary_lookback_units
        if len(cuts) > most:  # the closest in length, then the cheapest of all, each cut once
            close = sorted(cuts, key=lambda c: c[1])[: max(2, most // 2)]
            cheap = sorted(cuts, key=lambda c: c[0])[: max(2, most - len(close))]
            cuts = list({c[2]: c for c in close + cheap}.values())
        if not cuts and sizes[start] > high:
            raise ValueError(f"a unit of {sizes[start]} tokens does not fit into {high}")
        cut = min(cuts, key=lambda c: c[:2])[2] if cuts else start + 1
        out.append((start, cut))
        start = cut
    return out


class Splitter:
    """Splits units that are larger than a body may be."""

    def __init__(self, config: ChunkConfig, encode: Callable, target: int, most: int):
        self.config, self.encode, self.target, self.most = config, encode, target, most

    def split(self, unit: dict) -> list[dict]:
        """A unit's pieces; the unit itself where it fits and, if program text, holds one definition."""
        size = rules.tokens(unit["text"])
        python = unit["kind"] == "code" and code.is_python(unit["text"])
        if size <= self.most and not (python and (size > self.target or len(code.blocks(unit["text"])) > 1)):
            return [unit]
        ways = {"table": self.table, "list": self.items, "faq": self.answer, "code": self.program}
        pieces = self._pieces(unit, *ways.get(unit["kind"], self.prose)(unit))
        return [q for p in pieces for q in ([p] if rules.tokens(p["text"]) <= self.most else self._pieces(p, *self.prose(p)))]

    def _pieces(self, unit: dict, texts: list[str], strategy: str) -> list[dict]:
        many = len(texts) > 1 and strategy == "code_top_level"
        return [
            unit | {"unit_id": _hash("unit_piece", unit["unit_id"], str(k), t), "original_unit_id": unit["unit_id"], "text": t, "split_strategy": strategy, "break_before": many and k > 0, "break_after": many, "signature": code.signature(t) if strategy == "code_top_level" else None}
            for k, t in enumerate(texts)
        ]

    def _pack(self, parts: list, text: Callable[[list], str], lead: list) -> tuple[list[list], list]:
        """Parts behind ``lead`` in runs of up to the target; and those too large to stand even alone."""
        runs, run, large = [], [], []
        for part in parts:
            if run and rules.tokens(text([*lead, *run, part])) > self.target:
                runs.append(run)
                run = []
            run = [*run, part]
            if rules.tokens(text([*lead, *run])) > self.most:
                large.append(len(runs))
                runs.append(run)
                run = []
        return runs + ([run] if run else []), large

    def table(self, unit: dict) -> tuple[list[str], str]:
        rows = unit.get("rows") or []
        if len(rows) <= 1:
            return self.prose(unit)
        runs, _ = self._pack(rows[1:], rules.markdown, [rows[0]])
        return [rules.markdown([rows[0], *run]) for run in runs], "table_rows"

    def items(self, unit: dict) -> tuple[list[str], str]:
        lines = [x for x in map(str.strip, unit["text"].splitlines()) if x]
        first = next((k for k, x in enumerate(lines) if rules.list_line(x)), 0)
        lead, parts = lines[:first], lines[first:]
        if len(parts) <= 1:
            return self.prose(unit)
        runs, large = self._pack(parts, "\n".join, lead)
        room = max(20, self.most - rules.tokens("\n".join(lead)))
        cut = [[x] for k, run in enumerate(runs) for x in (rules.hard_split("\n".join(run), room) if k in large else ["\n".join(run)])]
        label = (unit["heading_path"][-1] if unit["heading_path"] else fixed.LIST_TITLE) + fixed.CONTINUED
        return ["\n".join([*([label] if k else []), *lead, *run]) for k, run in enumerate(cut)], "list_items"

    def answer(self, unit: dict) -> tuple[list[str], str]:
        found = re.match(r"(?is)(?P<q>(?:Q(?:uestion)?|问(?:题)?)[：:].*?)\n(?P<a>(?:A(?:nswer)?|答(?:案)?)[：:].*)", unit["text"])
        if not found:
            return self.prose(unit)
        question = found["q"].strip()
        used = rules.tokens(question)
        groups = self.sentences(rules.sentences(found["a"].strip()), max(20, self.target - used), max(30, self.most - used))
        return [question + "\n" + g for g in groups], "faq_answer_sentences"

    def program(self, unit: dict) -> tuple[list[str], str]:
        out: list[str] = []
        run: list[str] = []
        opens = lambda x: bool(rules.rx(r"\s*(?:@|(?:async\s+def|def|class)\b)").match(x))
        defines = lambda x: bool(rules.rx(r"(?m)^\s*(?:async\s+def|def|class)\b").search(x))
        flush = lambda: (out.append("\n\n".join(run)), run.clear()) if run else None
        for block in code.blocks(unit["text"]) if code.is_python(unit["text"]) else [unit["text"]]:
            if rules.tokens(block) > self.most:
                flush()
                out += self.long_block(block)
                continue
            if run and (rules.tokens("\n\n".join([*run, block])) > self.target or (opens(block) and any(map(defines, run)))):
                flush()
            run.append(block)
        flush()
        return out or [unit["text"]], "code_top_level"

    def long_block(self, block: str) -> list[str]:
        """A definition in pieces that all repeat its signature."""
        signature, lines = code.signature(block), block.splitlines()
        if not signature or len(lines) <= 2:
            return rules.hard_split(block, self.most)
        at = next(k for k, x in enumerate(lines) if x.rstrip() == signature) + 1
        head = "\n".join(lines[:at])
        room = max(30, self.most - rules.tokens(head) - rules.tokens(fixed.CONTINUED_CODE))
        runs: list[list[str]] = [[]]
        for line in lines[at:]:
            if runs[-1] and rules.tokens("\n".join([*runs[-1], line])) > room:
                runs.append([])
            runs[-1].append(line)
        out = []
        for k, run in enumerate(runs):
            top, body = head if k == 0 else head + "\n" + fixed.CONTINUED_CODE, "\n".join(run)
            parts = [body] if rules.tokens(top + "\n" + body) <= self.most else rules.hard_split(body, room)
            out += [top + "\n" + p for p in parts]
        return out

    def prose(self, unit: dict) -> tuple[list[str], str]:
        found = rules.sentences(unit["text"])
        if len(found) <= 1:
            return rules.hard_split(unit["text"], self.most), "hard_text"
        return self.sentences(found, self.target, self.most), "semantic_sentences"

    def sentences(self, found: list[str], target: int, most: int) -> list[str]:
        parts = [p for s in found for p in ([s] if rules.tokens(s) <= most else rules.hard_split(s, most))]
        sizes = [rules.tokens(p) for p in parts]
        ranges = partition(sizes, neighbours(parts, sizes, target, self.encode), [None] * len(parts), min(self.config.min_tokens, target), target, most, self.config, 0.0)
        return ["\n".join(parts[a:b]) for a, b in ranges]


def _prefix_tokens(file_name: str, path: list[str], pages: int, config: ChunkConfig) -> int:
    sample = rules.prefix(file_name, "Child", path, 1, max(1, pages)) + "\n\n" if config.include_source_prefix else ""
    return rules.tokens(sample) + 4


def expand(units: list[dict], prefix: int, config: ChunkConfig, encode: Callable) -> list[dict]:
    """A section's units, oversized ones in pieces."""
    splitter = Splitter(config, encode, max(30, config.target_tokens - prefix), max(40, config.max_tokens - prefix))
    blank = {"original_unit_id": None, "split_strategy": None, "break_before": False, "break_after": False, "signature": None}
    return [p for u in units for p in splitter.split(blank | u)]


def pack(pieces: list[dict], prefix: int, config: ChunkConfig, encode: Callable) -> list[tuple[list[dict], list[dict]]]:
    """``(overlap, own pieces)`` of each child of a section."""
    low = max(1, config.min_tokens - prefix)
    target = max(low, config.target_tokens - prefix)
    high = max(target, config.max_tokens - prefix)
    segments: list[list[dict]] = [[]]
    for p in pieces:
        if p["break_before"] and segments[-1]:
            segments.append([])
        segments[-1].append(p)
        if p["break_after"]:
            segments.append([])
    out: list[tuple[list[dict], list[dict]]] = []
    for segment in filter(None, segments):
        sizes = [rules.tokens(p["text"]) for p in segment]
        near = neighbours([p["text"] for p in segment], sizes, target, encode)
        for a, b in partition(sizes, near, [p["group_id"] for p in segment], low, target, high, config):
            room, tail = min(config.overlap_tokens, high - sum(sizes[a:b])), []
            for p in reversed(out[-1][1] if out else []):
                room -= rules.tokens(p["text"])
                if room < 0:
                    break
                tail.insert(0, p)
            out.append((tail, segment[a:b]))
    return out


def _by_section(sections: DataFrame, units: DataFrame, documents: DataFrame) -> DataFrame:
    """Units with what their section's fold needs."""
    s = sections.select("document_id", "section_seq", "section_id").join(documents.select("document_id", "file_name", "page_count"), "document_id")
    return units.join(s, ["document_id", "section_seq"]).select("document_id", "section_id", "file_name", "page_count", "unit_id", "unit_seq", "kind", "text", "page_start", "page_end", "heading_path", "group_id", "rows")


def chunk(sections: DataFrame, units: DataFrame, documents: DataFrame, config: ChunkConfig, semantic: SemanticConfig | None = None, table=lambda df, _: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``parents, children, pieces``. Children have links to their neighbours and are no longer than ``max_tokens``.
    ``table(df, name)`` may write what both folds give, as more than one step reads it."""
    semantic = semantic or SemanticConfig()
    backend, dimensions = semantic.backend, semantic.hashing_dimensions
    rows = _by_section(sections, units, documents)

    def prepared(section: list[dict], order: str) -> tuple[list[dict], int, Callable]:
        found = sorted(section, key=lambda r: late(r[order]))
        return found, _prefix_tokens(found[0]["file_name"] or "", found[0]["heading_path"], found[0]["page_count"] or 1, config), vectors.encoder(backend, dimensions)

    def split(section: list[dict]) -> list[dict]:
        found, prefix, encode = prepared(section, "unit_seq")
        return [p | {"piece_seq": k} for k, p in enumerate(expand(found, prefix, config, encode))]

    pieces = table(by_group(rows, ["document_id", "section_id"], split, EXPANDED), "pieces")
    doc = documents.select("document_id", "file_name", "page_count")

    def build(section: list[dict]) -> list[dict]:
        found, prefix, encode = prepared(section, "piece_seq")
        one = found[0]
        parent = _hash("parent", one["document_id"], one["section_id"])
        out = []
        for k, (tail, own) in enumerate(pack(found, prefix, config, encode)):
            body = tail + own
            ids = [p["unit_id"] for p in own]
            out.append({
                "document_id": one["document_id"], "section_id": one["section_id"], "parent_id": parent, "chunk_index": k, "child_id": _hash("child", parent, str(k), *ids), "text": "\n\n".join(p["text"] for p in body),
                "page_start": min(p["page_start"] for p in body), "page_end": max(p["page_end"] for p in body), "heading_path": one["heading_path"], "unit_ids": ids, "overlap_unit_ids": [p["unit_id"] for p in tail], "unit_count": len(ids),
            })
        return out

    packed = table(by_group(pieces.join(doc, "document_id"), ["document_id", "section_id"], build, CHILD), "packed")
    about = sections.select("section_id", "title", "record_type", "page_roles", "index_enabled")
    children = packed.join(doc, "document_id").join(about, "section_id")
    children = children.withColumn("content", content(config, "Child")).withColumn("token_estimate", T.estimate_tokens(F.col("content")))
    children = children.withColumn("token_estimate", F.when(F.col("token_estimate") <= config.max_tokens, F.col("token_estimate")).otherwise(F.raise_error(F.concat(F.lit("child too large: "), F.col("child_id"))).cast("long")))
    children = link_siblings(children).select(
        "child_id", "parent_id", "document_id", "section_id", "chunk_index", "content", "text", "token_estimate", "page_start", "page_end", "heading_path", "unit_ids", "overlap_unit_ids", "previous_child_id", "next_child_id",
        F.col("record_type").alias("content_type"), "page_roles", "index_enabled", F.lit(backend).alias("semantic_backend"),
    )
    bodies = pieces.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_seq", "text"))), lambda x: x.text), "\n\n").alias("text"))
    kids = packed.groupBy("section_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "child_id"))), lambda x: x.child_id).alias("child_ids"))
    parents = sections.join(bodies, "section_id").join(kids, "section_id").join(doc, "document_id").withColumn("content", content(config, "Parent"))
    parents = parents.select("parent_id", "document_id", "section_id", "title", "heading_path", "content", "text", T.estimate_tokens(F.col("content")).alias("token_estimate"), "page_start", "page_end", "child_ids", F.col("record_type").alias("content_type"), "page_roles", "index_enabled")
    return parents, children, pieces


def content(config: ChunkConfig, kind: str):
    """A chunk's body behind its prefix."""
    body = T.strip(F.col("text"))
    if not config.include_source_prefix:
        return body
    return F.concat(T.source_prefix(F.coalesce("file_name", F.lit("")), kind, F.col("heading_path"), F.col("page_start"), F.col("page_end")), F.lit("\n\n"), body)


def link_siblings(children: DataFrame, parent: str = "parent_id", order: str = "chunk_index", ident: str = "child_id") -> DataFrame:
    """Children with the ids of the ones before and behind them under the same parent."""
    by = Window.partitionBy(parent).orderBy(order)
    return children.withColumns({"previous_child_id": F.lag(ident).over(by), "next_child_id": F.lead(ident).over(by)})


def flat_chunks(blocks: DataFrame, chunk_tokens: int = 500, overlap_tokens: int = 80, least_tokens: int = 40) -> DataFrame:
    """First-generation chunks: a document's blocks in order, packed to a size with a tail of the one before, whatever
    the headings; a last chunk below ``least_tokens`` joins its neighbour. ``document_id, chunk_index, text, token_estimate``."""

    import pandas as pd

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [q for t in frame.sort_values(["page_number", "y0", "block_no"], kind="stable")["text"] for q in rules.hard_split(rules.clean(t), chunk_tokens)]
        runs, run = [], []
        for part in parts:
            if run and sum(map(rules.tokens, [*run, part])) > chunk_tokens:
                runs.append(run)
                keep, room = [], min(overlap_tokens, chunk_tokens - rules.tokens(part))
                for p in reversed(run):
                    room -= rules.tokens(p)
                    if room < 0:
                        break
                    keep.insert(0, p)
                run = keep
            run = [*run, part]
        runs += [run] if run else []
        if len(runs) > 1 and sum(map(rules.tokens, runs[-1])) < least_tokens:
            last = runs.pop()
            runs[-1] += [p for p in last if p not in runs[-1]]
        texts = ["\n".join(r) for r in runs]
        return pd.DataFrame({"document_id": frame["document_id"].iloc[0], "chunk_index": range(len(texts)), "text": texts, "token_estimate": [rules.tokens(t) for t in texts]})

    return blocks.select("document_id", "page_number", "y0", "block_no", "text").groupBy("document_id").applyInPandas(fold, "document_id string, chunk_index int, text string, token_estimate long")
