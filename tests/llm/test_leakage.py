"""Leaks against a plain quadratic alignment, and disfigured passages."""

import random
import tracemalloc

import numpy as np
import pytest

from weir.llm import leakage


def plain_leak(item, doc, stretch):
    """Every start in the item and the document, every edit, by dynamic programming over
    (item token, document token) -> the fewest edits for each length."""
    best = {}
    for i in range(len(item)):
        for j in range(len(doc)):
            table = {(0, 0): 0}
            for a in range(len(item) - i + 1):
                for b in range(len(doc) - j + 1):
                    options = [table.get((a, b), 99)]
                    if a and b:
                        options.append(table.get((a - 1, b - 1), 99) + (item[i + a - 1] != doc[j + b - 1]))
                    if a:
                        options.append(table.get((a - 1, b), 99) + 1)
                    if b:
                        options.append(table.get((a, b - 1), 99) + 1)
                    table[a, b] = min(options)
                    if a >= stretch and table[a, b] * 8 <= a:
                        return True
    return bool(best)


@pytest.mark.parametrize("seed", range(25))
def test_alignment_against_plain(seed):
    r = random.Random(seed)
    item = [r.randint(0, 40) for _ in range(18)]
    doc = item[r.randint(0, 4) : 18 - r.randint(0, 4)]
    for _ in range(r.randint(0, 3)):
        at = r.randint(0, len(doc) - 1)
        doc[at : at + 1] = r.choice([[], [99], [doc[at], 99]])
    doc = [r.randint(50, 60) for _ in range(3)] + doc + [r.randint(50, 60) for _ in range(3)]
    assert leakage.aligned(np.array(item), np.array(doc), 12) == plain_leak(item, doc, 12)


WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu") for b in ("ban", "der", "fin", "gol", "hus", "jem", "kip", "lar", "mon")]


def passage(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def brute(docs, items):
    out = set()
    for i, text in items:
        normal = leakage.normalise(text or "")
        stream = leakage.stream_of(normal)
        cut = list(leakage.letters(normal)) if stream == "letter" else leakage.words(normal)
        if len(cut) < leakage.WINDOW[stream].stretch:
            continue
        for d, t in docs:
            if t is None:
                continue
            n = leakage.normalise(t)
            own = list(leakage.letters(n)) if stream == "letter" else leakage.words(n)
            number = {}
            a, b = (np.array([number.setdefault(x, len(number)) for x in s], dtype=np.int64) for s in (cut, own))
            if len(b) and leakage.aligned(a, b, leakage.WINDOW[stream].stretch):
                out.add((d, i))
    return out


def test_operator_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(passage(r, r.randint(22, 60)))) for i in range(12)]
    items += [(50, "釈した樹脂混合物は針状の結晶を生じ観察者二名が残渣を量る間に対照との差を説明しなさいろ過した藻類の抽出液"), (51, "too short"), (52, None)]
    docs = []
    for d in range(120):
        words = passage(r, 40)
        own = r.choice(items[:12])[1].split()
        n = r.randint(14, len(own))
        piece = own[:n] if r.random() < 0.5 else own[-n:]
        for _ in range(r.randint(0, n // 7)):
            at = r.randint(0, len(piece) - 1)
            piece[at : at + 1] = r.choice([[], ["zzz"], [piece[at], "zzz"]])
        docs.append((d, " ".join(words[:20] + piece + words[20:])))
    docs += [(500, None), (501, ""), (502, "序" + items[12][1][3:46].replace("晶", "〇") + "跋"), (503, docs[0][1] * 300), (504, items[0][1])]
    spark_docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS ids", "'x' AS stream", "1 AS item_id")
    found = {tuple(x) for x in leakage.leaks(spark_docs, spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS i")).collect()}
    assert found == brute(docs, items) and len(found) > 40 and (502, 50) in found and (504, 0) in found
    assert leakage.leaks(spark_docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leakage.leaks(spark_docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_disfigurement_counts_as_no_change(spark):
    item = "The efficient café gel, which dörrt half its mass, keeps its odour for weeks because gravity sorts the heavier grains after nine freezing rounds in succession today"
    ways = [
        item.upper(), item.replace("fi", "ﬁ"), item.replace("é", "é"), item.replace("ö", "&ouml;"), item.replace("ö", "&amp;#246;"), item.replace(" ", "\n"),
        item.replace("weeks", "we-\n  eks").replace("heavier", "hea­vier"), item.replace(",", ""), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item),
    ]
    docs = spark.createDataFrame(list(enumerate(ways)), "doc_id bigint, text string")
    assert leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).count() == len(ways)


def test_several_blocks(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, " ".join(passage(r, 30))) for i in range(6)]
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 64)
    docs = spark.createDataFrame([(d, t) for d, t in items], "doc_id bigint, text string")
    assert {tuple(x) for x in leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()} == {(i, i) for i in range(6)}


def test_least_shared_holds_for_random_and_clustered_edits():
    r = random.Random(1)
    for stretch, gram in ((22, 3), (22, 4), (40, 4), (40, 5)):
        size, least = stretch - gram + 1, leakage.least_shared(stretch, gram)
        for _ in range(6000):
            n = r.randint(stretch, 2 * stretch - 1)
            low = r.randint(0, n - 1)
            high = r.randint(low + 1, n) if r.random() < 0.7 else n
            spoiled = set()
            for _ in range(n // 8):
                at = r.randrange(low, high) if r.random() < 0.9 else r.randrange(n)
                spoiled |= set(range(max(0, at - gram + 1), min(n - gram + 1, at + 1)))
            kept = [k not in spoiled for k in range(n - gram + 1)]
            assert max(sum(kept[s : s + size]) for s in range(n - stretch + 1)) >= least


def test_a_passage_of_several_pieces(spark, monkeypatch):
    """A passage longer than a block is cut into pieces; no stretch gets lost, and none stops the job."""
    r = random.Random(12)
    text = passage(r, 700)
    docs = [(i, " ".join(passage(r, 9) + text[at : at + 22 + i % 20] + passage(r, 9))) for i, at in enumerate(range(0, 660, 7))]
    given = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(text))], "item_id bigint, text string")
    whole = {tuple(x) for x in leakage.leaks(given, items).collect()}
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 150)
    assert {tuple(x) for x in leakage.leaks(given, items).collect()} == whole == {(i, 1) for i in range(len(docs))}


def test_only_prefix_postings_are_joined():
    """Documents that share frequent shingles only read no posting of them; a prefix holds what is rare."""
    r = random.Random(4)
    common = passage(r, 8)
    pieces = [(i, "word", passage(r, 18) + common + passage(r, 18)) for i in range(40)]
    block = leakage.Block(pieces)
    rule = leakage.WINDOW["word"]
    frequency = {s: np.zeros(block.gram_count(s), dtype=np.int64) for s in leakage.WINDOW}
    shared = np.unique(block.grams[0][18 : 18 + len(common) - rule.gram + 1])
    frequency["word"][shared] = 1000
    prefix = leakage.prefixes(block, frequency)
    postings = leakage.Postings(block, "word", prefix)
    everything = sum(int(np.isin(g, shared).sum()) for g in block.grams)
    found, read = postings.items(shared)
    assert everything == 200 and read == len(found) == 0
    for (_, _, ids), grams, chosen in zip(block.items, block.grams, prefix, strict=True):
        for start in range(len(ids) - rule.stretch + 1):
            own = chosen[start : start + rule.size]
            assert own.sum() >= rule.size - rule.least + 1
    no_prefix = leakage.Postings(block, "word", [np.zeros(len(g), dtype=bool) for g in block.grams])
    at = np.arange(len(block.grams[3]))
    assert postings.candidates(at, block.grams[3].astype(np.int64), rule) and not no_prefix.candidates(at, block.grams[3].astype(np.int64), rule)


def test_a_block_of_many_letters_stays_small():
    letters = "".join(chr(0x4E00 + (i * i + 7 * i) % 3000) for i in range(300_000))
    tracemalloc.start()
    block = leakage.Block(leakage._pieces(1, letters, leakage.BLOCK_TOKENS))
    leakage.prefixes(block, {s: np.zeros(block.gram_count(s), dtype=np.int64) for s in leakage.WINDOW})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000 * 350  # with the windows sorted at a time; a full block stays below 700 MB
