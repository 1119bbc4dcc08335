"""Quality rules by tokeniser fertility, beside fixed counts of a text.

*Counts* of every whole text: words, code points in words, symbols, repeated lines, words in repeated 8-word windows.
``base_failed``: under 20 words, or over 30 % of the words in repeated windows.

*Fertility.* Public vocabularies encode every word (distinct words of a slice once): characters per token of each
vocabulary, the share of tokens that fall back to bytes, and the entropy of the text's tokens as a share of the
greatest possible for their number. The vocabularies are files whose paths are parameters; the driver reads them and
their few bytes travel with the task.

*Bands.* The middle of a measure for a language is its median over the documents that pass the fixed rules, drawn towards
the median of the text's script, and that towards the median of all documents, by the number of documents: n of them
weigh n against ``PRIOR``. So a group of any size has a band, and a handful of odd texts cannot make one of their own. How
far texts lie from the middle depends on their length: the quartiles of that distance are taken over all documents of like
length (powers of two of the number of pieces), drawn towards those of all lengths in the same way. A text is rejected if a
measure lies more than ``REACH`` interquartile ranges (at least ``FLOOR`` of the middle) beyond these quartiles.

Medians and quartiles are exact ranks of values rounded to a fixed grid (``GRID``): counts by value, which are combined
before they are exchanged and do not depend on the order or partitioning of rows. One pass reads the texts; what it counts
is stored.

Defined cases: null or empty text: no words, base_failed, not kept. A null lang falls back to the script of most
letters (``none`` without letters). Repeated rows get equal results and count each in the quartiles. A null doc_id is
carried along. Columns other than doc_id, text and lang are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batch_of, columns_of, slices, stored

PIECES, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The thresholds of the base rules and the pattern by which byte-level vocabularies split a text.
MIN_WORDS, REPEAT_SHARE, REPEAT_WINDOW = 20, 30, 8
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REACH, FLOOR, PRIOR = 6, 0.01, 50
MEASURES = ("chars_per_piece", "chars_per_token", "byte_share", "token_entropy")
GRID = (512, 512, 4096, 4096)  # steps of one unit of each measure
# First code point of each block of letters, in order, and its script.
_BLOCKS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
           (0x1000, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han")]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CACHE: dict = {}


class Vocabularies:
    """Both vocabularies, and what they make of a word; the last words are remembered."""

    KEEP = 200_000

    def __init__(self, pieces: bytes, ranks: bytes):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokens = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.known: dict[bytes, tuple[list[int], int]] = {}

    def encode(self, words: list[bytes]) -> list[tuple[list[int], int]]:
        """Pieces and number of byte-level tokens of each word."""
        if len(self.known) > self.KEEP:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            texts = [w.decode("utf-8", "replace") for w in new]
            ids = self.pieces.encode(texts, num_threads=1)
            for w, a, b in zip(new, ids, texts):
                self.known[w] = (a, len(self.tokens.encode_ordinary(" " + b)))
        return [self.known[w] for w in words]


def _vocabularies(pieces: bytes, ranks: bytes) -> Vocabularies:
    key = (hash(pieces), hash(ranks))
    if key not in _CACHE:
        _CACHE[key] = Vocabularies(pieces, ranks)
    return _CACHE[key]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each row the words that lie in k-word windows found twice or more in it."""
    start, value = words.windows(k)
    row = words.row[start]
    order = np.lexsort((value, row))
    same = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    twice = np.zeros(len(start), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, start[twice], 1)
    np.add.at(step, start[twice] + k, -1)
    return _sums((np.cumsum(step[:-1]) > 0).astype(np.int64), words.first)


def repeated_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(text: str | None) -> str:
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code[(code >= 0xAA) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))]
    if not len(code):
        return "none"
    block = np.searchsorted([b for b, _ in _BLOCKS], code, "right") - 1
    count: dict[str, int] = {}
    for i, n in zip(*np.unique(block, return_counts=True)):
        count[_BLOCKS[i][1]] = count.get(_BLOCKS[i][1], 0) + int(n)
    return min(count, key=lambda s: (-count[s], s))


def fertility(words: Words, vocabularies: Vocabularies, chars: np.ndarray) -> dict[str, np.ndarray]:
    """The four measures of each row, and its number of pieces."""
    _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    known = vocabularies.encode([data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())])
    n_pieces = np.array([len(a) for a, _ in known], np.int64)
    n_tokens = np.array([b for _, b in known], np.int64)
    flat = np.concatenate([np.array(a, np.int64) for a, _ in known]) if known else np.zeros(0, np.int64)
    begin = np.cumsum(n_pieces) - n_pieces
    n_bytes = _sums(vocabularies.byte[flat].astype(np.int64), np.append(begin, len(flat)))
    pieces, tokens, fallback = (_sums(x[back], words.first) for x in (n_pieces, n_tokens, n_bytes))
    # pieces of every word in order, then counts of each (row, piece)
    n = n_pieces[back]
    place = np.repeat(begin[back] - np.cumsum(n) + n, n) + np.arange(n.sum())
    code = np.repeat(words.row, n) * len(vocabularies.byte) + flat[place]
    code.sort()
    new = np.flatnonzero(np.diff(code, prepend=-1))
    count = np.diff(np.append(new, len(code)))
    row = code[new] // len(vocabularies.byte)
    share = count / np.maximum(pieces, 1)[row]
    entropy = np.bincount(row, -share * np.log2(share), words.rows)
    ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    return {"chars_per_piece": ratio(chars, pieces), "chars_per_token": ratio(chars, tokens), "byte_share": ratio(fallback, pieces),
            "token_entropy": np.where(pieces > 1, entropy / np.log2(np.maximum(pieces, 2)), 0.0), "n_pieces": pieces}


def _measured(pieces: bytes, ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(pieces, ranks)
        for batch in slices(batches, "text"):
            words, texts = Words(batch.column("text")), batch.column("text").to_pylist()
            first = (words.data & 0xC0) != 0x80
            inside = np.zeros(len(words.data) + 1, np.int64)
            np.add.at(inside, words.start, 1)
            np.add.at(inside, words.end, -1)
            chars = _sums((first & (np.cumsum(inside[:-1]) > 0)).astype(np.int64), words.offsets)
            more = fertility(words, vocabularies, chars)
            langs, scripts = batch.column("lang").to_pylist(), [script_of(t) for t in texts]
            yield batch_of({
                "doc_id": (batch.column("doc_id"), None), "group": ([x or s for x, s in zip(langs, scripts)], pa.string()), "script": (scripts, pa.string()), "n_words": (words.count, pa.int64()),
                "word_chars": (chars, pa.int64()), "n_symbols": (_sums(_SYMBOL[words.data].astype(np.int64), words.offsets), pa.int64()),
                "n_dup_lines": ([repeated_lines(t) for t in texts], pa.int64()), "n_repeat_words": (repeated_words(words), pa.int64()),
                "n_pieces": (more["n_pieces"], pa.int64()), **{m: (more[m], pa.float64()) for m in MEASURES},
            })
    return run


def measured(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """One row for each row of docs: counts, measures, script and group (language, or script where it is null)."""
    with open(pieces, "rb") as a, open(ranks, "rb") as b:
        run = _measured(a.read(), b.read())
    docs = columns_of(docs, "doc_id", "text", "lang")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, group string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, n_pieces long, " + ", ".join(f"{m} double" for m in MEASURES))


def _levels(rows: DataFrame, values: list, *keys: str) -> DataFrame:
    """keys…, n and for each value its quartiles, as arrays in the order of values; exact ranks on the grid."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.rint(v * g).cast("long").alias("level")) for k, (v, g) in enumerate(zip(values, GRID))])
    counts = rows.select(*keys, F.inline(cells)).groupBy(*keys, "k", "level").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys, "k")
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("level"))).withColumn("all", F.sum("n").over(by))
    part = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("level"))).alias(f"q{q}")
    quartiles = upto.groupBy(*keys, "k").agg(F.max("all").alias("n"), part(1), part(2), part(3))
    back = lambda q: F.transform(F.col("x"), lambda x: x[f"q{q}"] / F.array(*[F.lit(float(g)) for g in GRID])[x["k"]]).alias(f"q{q}")
    wide = quartiles.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "q1", "q2", "q3"))).alias("x"))
    return wide.select(*keys, "n", back(1), back(2), back(3))


def _drawn(own, n, wider):
    """A group's value drawn towards that of the wider one; no documents of its own: the wider one's."""
    n = F.coalesce(n, F.lit(0))
    return F.coalesce((n * own + PRIOR * wider) / (n + PRIOR), wider)


def _banded(rows: DataFrame) -> DataFrame:
    """rows with the middle of each measure, and the quartiles of the distance from it in texts of like length."""
    passed, of = rows.where("not base_failed"), lambda m, c: F.col(c)[m]
    values = [F.col(m) for m in MEASURES]
    middles = lambda df, name, *keys: df.select(*keys, F.col("n").alias(f"n_{name}"), F.col("q2").alias(f"mid_{name}"))
    rows = rows.withColumn("everything", F.lit("all")).withColumn("length", F.floor(F.log2(F.greatest("n_pieces", F.lit(1)))).cast("int"))
    for key in ("group", "script"):
        rows = rows.join(middles(_levels(passed, values, key), key, key), key, "left")
    whole = _levels(passed.withColumn("everything", F.lit("all")), values, "everything")
    rows = rows.join(middles(whole, "all", "everything"), "everything", "left")
    for k, m in enumerate(MEASURES):
        rows = rows.withColumn(f"mid_{m}", _drawn(of(k, "mid_group"), F.col("n_group"), _drawn(of(k, "mid_script"), F.col("n_script"), of(k, "mid_all"))))
    rows = rows.drop("mid_group", "mid_script", "mid_all", "n_group", "n_script", "n_all")
    passed, away = rows.where("not base_failed"), [F.col(m) - F.col(f"mid_{m}") for m in MEASURES]
    spread = lambda df, name, key: df.select(key, F.col("n").alias(f"n_{name}"), F.col("q1").alias(f"low_{name}"), F.col("q3").alias(f"high_{name}"))
    rows = rows.join(spread(_levels(passed, away, "length"), "length", "length"), "length", "left").join(spread(_levels(passed, away, "everything"), "all", "everything"), "everything", "left")
    for k, m in enumerate(MEASURES):
        for side in ("low", "high"):
            rows = rows.withColumn(f"{side}_{m}", _drawn(of(k, f"{side}_length"), F.col("n_length"), of(k, f"{side}_all")))
    return rows


def judged(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """doc_id, counts, base_failed and kept of each row, with its measures and the one that rejected it (reason)."""
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_SHARE} * n_words"
    rows = _banded(stored(measured(docs, pieces, ranks)).withColumn("base_failed", F.expr(failed)))

    def outside(m: str):
        away, low, high = F.col(m) - F.col(f"mid_{m}"), F.col(f"low_{m}"), F.col(f"high_{m}")
        reach = REACH * F.greatest(high - low, FLOOR * F.col(f"mid_{m}"), F.lit(0.002))
        return (away < low - reach) | (away > high + reach)

    reason = F.when(F.col("base_failed"), "base").otherwise(F.coalesce(*[F.when(outside(m), m) for m in MEASURES]))
    return rows.withColumn("reason", reason).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), *MEASURES, "reason")
