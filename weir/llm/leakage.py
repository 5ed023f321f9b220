"""Documents that contain held-out passages, whole or in part, even disfigured.

A prefix-filtered set join. Texts are normalised and cut into words (letters for Chinese and
Japanese); the sets are the word n-grams ("shingles") of the passages' windows. Every stretch that counts
as a leak has an aligned window of which a document must share at least ``WINDOW[stream].least``
shingles, so it must share one of the window's rarest ``size - least + 1``, the prefix, ordered by how
many documents hold them. Only the postings of prefix tokens are joined; the items they name are then
bounded by length and position and aligned exactly.

Documents stream through ``mapInArrow`` and are never shuffled. The passages are the query set: they go
to every task in blocks of at most ``BLOCK_TOKENS`` tokens, one pass a block, so what is broadcast has a
bound whatever their number; longer passages are cut into pieces that overlap by more than any stretch
needs. Documents that share no shingle leave after the first step; of the others only the numbers of
their words are kept, in the checkpoint folder.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.sources.session import cut, ensure_importable

#: Tokens of passages in a block. The driver needs some 150 bytes a token, a task some 60.
BLOCK_TOKENS = 2_000_000
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿々〇"
_IS_CJK = re.compile(f"[{_CJK}]")
_TOKENS = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+")
_NOT_ALNUM = re.compile(r"[\W_]+")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑­](?:[^\S\n]*\n\s*)?(?=\w)")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]+")


class Window(NamedTuple):
    """A stream's rules: shortest stretch, shingle size, shingles that a window must share."""

    stretch: int
    gram: int
    least: int

    @property
    def size(self) -> int:
        return self.stretch - self.gram + 1


def least_shared(stretch: int, gram: int, one_in: int = 8) -> int:
    """The fewest shingles that the best aligned window of ``stretch`` tokens shares, over every stretch
    with up to one edit in ``one_in`` tokens; an edit spoils at most ``gram`` shingles.

    A leak of two stretches or more has a half that is a leak, so shorter ones are in question. Two
    windows, at either end, hold all shingles of such a stretch. What is left of them is shared by one of
    the two to at least a half. And with k of the edits in the part that both windows cover, where they
    spoil at most the shingles that touch it, one of the two has at most half of the other edits.
    """
    size = stretch - gram + 1
    least = size
    for n in range(stretch, 2 * stretch):
        edits, common = n // one_in, 2 * stretch - n
        left = n - gram + 1 - gram * edits
        halved = -(-left // (1 if n == stretch else 2))
        spread = min(size - min(gram * k, common + gram - 1) - gram * ((edits - k) // 2) for k in range(min(edits, common) + 1))
        least = min(least, max(halved, spread))
    return least


WINDOW = {"word": Window(22, 4, least_shared(22, 4)), "letter": Window(40, 4, least_shared(40, 4))}
EDIT = 8  # one edit in so many tokens


def normalise(text: str) -> str:
    """Case, width, ligatures, character references, separate accents and hyphenation undone."""
    for _ in range(2):  # references may themselves be escaped
        if "&" in text:
            text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text.casefold())


def words(normal: str) -> list[str]:
    return _TOKENS.findall(normal)


def letters(normal: str) -> str:
    return _NOT_ALNUM.sub("", normal)


def stream_of(normal: str) -> str:
    """Which tokens a passage consists of: letters if most of it is Chinese or Japanese."""
    found = len(_IS_CJK.findall(normal))
    return "letter" if found * 2 > len(letters(normal)) else "word"


class Block:
    """The shingles of some passages, by number. ``pieces`` are (item_id, stream, tokens)."""

    def __init__(self, pieces: Iterable[tuple]) -> None:
        self.vocabulary: dict[str, dict[str, int]] = {s: {} for s in WINDOW}
        self.items: list[tuple] = []  # (item_id, stream, token numbers)
        for item_id, stream, tokens in pieces:
            known = self.vocabulary[stream]
            ids = np.fromiter((known.setdefault(t, len(known)) for t in tokens), dtype=np.int32, count=len(tokens))
            self.items.append((item_id, stream, ids))
        self.codes: dict[str, np.ndarray] = {}  # the number of a shingle is its place among the codes
        self.grams: list[np.ndarray] = [np.empty(0, np.int32)] * len(self.items)  # per item: the shingle at each position
        for stream, rule in WINDOW.items():
            own = [i for i, item in enumerate(self.items) if item[1] == stream]
            parts = [self._code(stream, self.items[i][2].astype(np.int64), np.arange(len(self.items[i][2]) - rule.gram + 1)) for i in own]
            self.codes[stream], number = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_inverse=True)
            for i, grams in zip(own, np.split(number.astype(np.int32), np.cumsum([len(p) for p in parts])[:-1]), strict=False):
                self.grams[i] = grams

    def _code(self, stream: str, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A whole number for the shingle at each of the positions ``at``."""
        gram, base = WINDOW[stream].gram, len(self.vocabulary[stream]) + 1
        if base**gram >= 2**63:
            return hash_ids(np.stack([ids[at + k] for k in range(gram)], axis=1), 0)
        return sum(ids[at + k] * base**k for k in range(gram))

    def shingles(self, stream: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` at which a shingle of the block starts, and its number."""
        codes = self.codes[stream]
        gram = WINDOW[stream].gram
        if not len(codes) or len(ids) < gram:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(ids) - gram + 1
        known = ids >= 0
        whole = known[:n].copy()
        for k in range(1, gram):
            whole &= known[k : n + k]
        at = np.flatnonzero(whole)
        if not len(at):
            return at, at
        code = self._code(stream, ids, at)
        found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[found] == code
        return at[hit], found[hit]

    def gram_count(self, stream: str) -> int:
        return len(self.codes[stream])


def hash_ids(ids: np.ndarray, seed: int) -> np.ndarray:
    """A 63-bit mix of rows of numbers, for vocabularies too large for a positional code."""
    mixed = np.full(len(ids), 0x9E3779B97F4A7C15 ^ seed, dtype=np.uint64)
    for k in range(ids.shape[1]):
        mixed = (mixed ^ ids[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(1)).astype(np.int64)


def _hits(block: Block):
    """Per document and stream: the shingles it shares with the block, and its words by number."""
    streams = [s for s in WINDOW if block.gram_count(s)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            kinds: list[str] = []
            grams: list[np.ndarray] = []
            kept: list[np.ndarray | None] = []
            normal = [normalise(v.as_py()) if v.is_valid else "" for v in batch.column(1)]
            for stream in streams:
                get = block.vocabulary[stream].get
                parts = []
                for text in normal:
                    if stream == "word":
                        tokens = words(text)
                    else:
                        tokens = "" if text.isascii() or not _IS_CJK.search(text) else letters(text)
                    parts.append(np.fromiter(map(get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens)))
                gap = np.full(WINDOW[stream].gram, -1, dtype=np.int64)
                ends = np.cumsum([len(p) + len(gap) for p in parts])
                at, number = block.shingles(stream, np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap)
                of = np.searchsorted(ends, at, side="right")
                bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else []
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    i = int(of[lo])
                    rows.append(i)
                    kinds.append(stream)
                    grams.append(np.unique(number[lo:hi]))
                    kept.append(parts[i].astype(np.int32) if hi - lo >= WINDOW[stream].least else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(grams, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], names=["_id", "stream", "grams", "ids"]
            )

    return run


def prefixes(block: Block, frequency: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Per item: whether the shingle at a position is among the rarest ``size - least + 1`` of some
    window. ``frequency`` has the number of documents by stream and shingle; ties go by number."""
    rank = {}
    for stream in WINDOW:
        order = np.lexsort((np.arange(block.gram_count(stream)), frequency[stream]))
        rank[stream] = np.empty(len(order), dtype=np.int32)
        rank[stream][order] = np.arange(len(order), dtype=np.int32)
    out = []
    for (_, stream, _), grams in zip(block.items, block.grams, strict=True):
        rule = WINDOW[stream]
        own = rank[stream][grams]
        kept = rule.size - rule.least + 1
        chosen = np.zeros(len(own), dtype=bool)
        for low in range(0, len(own) - rule.size + 1, 50_000):  # windows at a time
            view = np.lib.stride_tricks.sliding_window_view(own[low : low + 50_000 + rule.size - 1], rule.size)
            places = np.argsort(view, axis=1, kind="stable")[:, :kept] if kept < rule.size else np.broadcast_to(np.arange(rule.size), view.shape)
            chosen[(places + np.arange(low, low + len(view))[:, None]).ravel()] = True
        out.append(chosen)
    return out


def aligned(item: np.ndarray, doc: np.ndarray, stretch: int) -> bool:
    """Whether ``doc`` holds a stretch of at least ``stretch`` tokens of ``item`` with at most one edit
    in EDIT tokens.

    The score of a stretch is n - EDIT * edits, n the item's tokens in it; it must not be negative. A
    local alignment finds most leaks: what it finds is one, for a stretch that is too short may grow by
    tokens that count as changed if its score pays for them. What it does not find is settled exactly.
    """
    return _locally_aligned(item, doc, stretch) or _exactly_aligned(item, doc, stretch)


def _exactly_aligned(item: np.ndarray, doc: np.ndarray, stretch: int) -> bool:
    """The best score by length of the stretch and its end in the document. A stretch of twice the
    length or more has a half that is a leak, so lengths end there."""
    best = np.full((2 * stretch, len(doc) + 1), -(1 << 28), dtype=np.int64)
    slope = np.arange(len(doc) + 1, dtype=np.int64) * EDIT
    best[0] = 0
    for token in item:
        now = best[:-1] + (1 - EDIT)
        np.maximum(now[:, 1:], best[:-1, :-1] + np.where(doc == token, 1, 1 - EDIT), out=now[:, 1:])
        best[1:] = np.maximum.accumulate(now + slope, axis=1) - slope
        if best[stretch:].max() >= 0:
            return True
    return False


def _locally_aligned(item: np.ndarray, doc: np.ndarray, stretch: int) -> bool:
    unit = 1 << 20
    match, edit, extra = unit + 1, (1 - EDIT) * unit + 1, -EDIT * unit
    slope = np.arange(len(doc) + 1, dtype=np.int64) * EDIT * unit
    row = np.zeros(len(doc) + 1, dtype=np.int64)
    for token in item:
        step = np.where(doc == token, match, edit)
        now = np.empty_like(row)
        now[0] = 0
        now[1:] = np.maximum(row[:-1] + step, row[1:] + edit)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope) - slope
        row = now
        score, n = row >> 20, row & (unit - 1)
        if np.any((score >= 0) & (n + score // (EDIT - 1) >= stretch)):
            return True
    return False


class Postings:
    """In which items the shingles of a stream are prefix tokens, and where shingles stand in an item."""

    def __init__(self, block: Block, stream: str, prefix: list[np.ndarray]) -> None:
        own = [i for i, item in enumerate(block.items) if item[1] == stream]
        pairs = [np.stack([block.grams[i][prefix[i]].astype(np.int64), np.full(int(prefix[i].sum()), i)]) for i in own]
        table = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        self.begin = np.searchsorted(table[0], np.arange(block.gram_count(stream) + 1))
        self.item = table[1].astype(np.int32)
        self.order = {i: np.argsort(block.grams[i], kind="stable").astype(np.int32) for i in own}
        self.grams = {i: block.grams[i][self.order[i]] for i in own}

    def items(self, number: np.ndarray) -> tuple[np.ndarray, int]:
        """The items of which a document with these shingles holds a prefix token, and how many postings
        were read for that."""
        distinct = np.unique(number)
        counts = self.begin[distinct + 1] - self.begin[distinct]
        total = int(counts.sum())
        if not total:
            return self.item[:0], 0
        entry = np.repeat(self.begin[distinct] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
        return np.unique(self.item[entry]), total

    def diagonals(self, item: int, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Place in the document less place in the item, of every shingle they share, in order."""
        grams, order = self.grams[item], self.order[item]
        low, high = np.searchsorted(grams, number), np.searchsorted(grams, number, side="right")
        counts = high - low
        total = int(counts.sum())
        entry = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
        return np.sort(np.repeat(at, counts) - order[entry])

    def candidates(self, at: np.ndarray, number: np.ndarray, rule: Window) -> list[tuple[int, int, int]]:
        """(item, low, high): items that share a prefix token, with the diagonals near which enough
        shingles lie.

        A stretch of n tokens with e edits keeps at least n - gram + 1 - gram * e shingles, and its
        diagonals spread by at most e. A stretch of twice the length has a half that is a leak.
        """
        out = []
        for item in self.items(number)[0].tolist():
            key = self.diagonals(item, at, number)
            lows, highs = [], []
            for edits in range(rule.stretch // EDIT, 2 * rule.stretch // EDIT + 1):
                need = max(rule.stretch, EDIT * edits) - rule.gram + 1 - rule.gram * edits
                if need > len(key):
                    continue
                j = np.flatnonzero(key[need - 1 :] - key[: len(key) - need + 1] <= edits)
                lows.append(key[j + need - 1] - edits)
                highs.append(key[j] + edits)
            low, high = (np.concatenate(x) if x else key[:0] for x in (lows, highs))
            if not len(low):
                continue
            order = np.argsort(low, kind="stable")
            low, reach = low[order], np.maximum.accumulate(high[order])
            first = np.flatnonzero(np.r_[True, low[1:] > reach[:-1]])
            out += [(item, a, b) for a, b in zip(low[first].tolist(), reach[np.r_[first[1:] - 1, len(reach) - 1]].tolist(), strict=True)]
        return out


def may_align(item: np.ndarray, doc: np.ndarray, low: int, high: int, stretch: int) -> bool:
    """Whether enough of the item's tokens stand in ``doc`` on some diagonal from ``low`` to ``high``."""
    n = len(item)
    padded = np.full(n + high - low, -1, dtype=np.int64)
    begin, end = max(0, low), min(len(doc), high + n)
    if begin >= end:
        return False
    padded[begin - low : end - low] = doc[begin:end]
    met = (np.lib.stride_tricks.sliding_window_view(padded, n) == item).any(axis=0)
    gain = np.r_[0, np.cumsum(np.where(met, 1, 1 - EDIT))]
    return bool(np.any(gain[stretch:] - np.minimum.accumulate(gain)[: n + 1 - stretch] >= 0))


def _verify(block: Block, prefix: list[np.ndarray]):
    """(document, item) pairs of which the document's words hold a leak of the item."""
    postings = {s: Postings(block, s, prefix) for s in WINDOW}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list = []
            streams = batch.column(1).to_pylist()
            for i, stream in enumerate(streams):
                rule = WINDOW[stream]
                ids = np.asarray(batch.column(2)[i].values, dtype=np.int64)
                at, number = block.shingles(stream, ids)
                for item, low, high in postings[stream].candidates(at, number, rule):
                    item_id, _, own = block.items[item]
                    near = ids[max(0, low) : high + len(own)]
                    if may_align(own, ids, low, high, rule.stretch) and aligned(own, near, rule.stretch):
                        rows.append(i)
                        found.append(item_id)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=["_id", "item_id"])

    return run


def _pieces(item_id: int, text: str, most: int) -> Iterator[tuple]:
    """(item_id, stream, tokens) of a passage; one of more than ``most`` tokens in pieces that overlap by
    two stretches, so every stretch of less than two lies in one of them. Shorter ones cannot leak."""
    normal = normalise(text)
    stream = stream_of(normal)
    tokens = letters(normal) if stream == "letter" else words(normal)
    stretch = WINDOW[stream].stretch
    step = max(1, most - 2 * stretch)
    for low in range(0, max(1, len(tokens) - 2 * stretch), step):
        if len(tokens) - low >= stretch:
            yield item_id, stream, tokens[low : low + step + 2 * stretch]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The passages in blocks of about BLOCK_TOKENS tokens, in order of their id."""
    held: list[tuple] = []
    size = 0
    for row in items.select(items[item_id].cast("bigint").alias("i"), items[text].alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        for piece in _pieces(row["i"], row["t"], BLOCK_TOKENS):
            if size and size + len(piece[2]) > BLOCK_TOKENS:
                yield Block(held)
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
    if held:
        yield Block(held)


def _frequencies(hits: DataFrame, block: Block) -> dict[str, np.ndarray]:
    """The number of documents by stream and shingle, at most one row per shingle of the block."""
    counted = hits.select("stream", F.explode("grams").alias("gram")).groupBy("stream", "gram").count().toArrow()
    streams, grams, counts = np.asarray(counted["stream"].to_numpy()), counted["gram"].to_numpy(), counted["count"].to_numpy()
    out = {}
    for stream in WINDOW:
        own = streams == stream
        out[stream] = np.zeros(block.gram_count(stream), dtype=np.int64)
        out[stream][grams[own]] = counts[own]
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that holds a leak of an item, once each.

    Null and empty texts leak nothing; items shorter than a stretch cannot leak; without items the
    result is empty.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    spark = documents.sparkSession
    ensure_importable(spark)
    texts = documents.select(documents[doc_id].alias("_id"), documents[text].alias("_text"))
    found = None
    for block in _blocks(items, item_id, item_text):
        if not block.items:
            continue
        hits = cut(texts.mapInArrow(_hits(block), f"_id {kind}, stream string, grams array<bigint>, ids array<int>"))
        prefix = prefixes(block, _frequencies(hits, block))
        pairs = hits.where("ids is not null").select("_id", "stream", "ids").mapInArrow(_verify(block, prefix), f"_id {kind}, item_id bigint")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = spark.createDataFrame([], f"_id {kind}, item_id bigint")
    return found.distinct().withColumnRenamed("_id", doc_id)
