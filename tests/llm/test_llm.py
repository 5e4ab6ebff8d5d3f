from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ordina.llm import best_fit, byte_cnn, jaccard_join, language_id, link_rank, piece_lattice, quality_rules, suffix_dedup, token_counts, vector_tree
from ordina.llm import _text
from ordina.llm._word_ids import default_tokenizer, word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m string, Text string, n_words int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and long texts, copies, near copies, shared passages, repeated rows."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one", "a b c", base, base, " ".join(near), passage + " " + prose(3, 50), prose(4, 40) + " " + passage, prose(5, 9000), "x" * 5000, "é" * 300, "日本語 テキスト", "# $ % | <>", "dup line here\ndup line here\nother", ("a b c d e f g h " * 20), base]
    rows = [(k, t, ["en", "de", None][k % 3], ["src0", "src1", None][k % 3] if k % 4 else "src0", len(t or ""), "m", "other", 7) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


# --- kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t日\x00", max_size=30), min_size=1, max_size=6))
def test_words_of_buffers(texts):
    found = []
    for text in _text.parts(pa.array(texts), 16):
        start, end = text.words()
        rows = text.rows(start)
        raw = text.buf.tobytes()
        found += [(text.first + r, raw[a:b].decode()) for r, a, b in zip(rows, start, end)]
    assert found == [(k, w) for k, t in enumerate(texts) for w in words(t)]


# --- 1


def brute_rules(text: str | None) -> tuple:
    w, text = words(text), text or ""
    keys = defaultdict(list)
    for i in range(len(w) - 7):
        keys[tuple(w[i : i + 8])].append(i)
    again = {i + k for at in keys.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [s for s in text.split("\n") if words(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_rules_measures(odd):
    got = sorted([tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules.judge(odd).collect()])
    assert got == sorted(brute_rules(r.text) for r in odd.collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="a b\n#", max_size=80), min_size=1, max_size=5))
def test_quality_rules_kernel(texts):
    got = [tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules._measure(pa.array(texts)).to_pylist()]
    assert got == [brute_rules(t) for t in texts]


def test_quality_rules_hosts(spark, none):
    good, bad = prose(9, 60), "too short"
    rows = [(k, good, "en", "good", 0, None, None, None) for k in range(20)] + [(100 + k, bad if k < 19 else good, "en", "bad", 0, None, None, None) for k in range(20)] + [(200, good, "en", None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[0].kept and got[200].kept and not got[100].kept
    assert not got[119].kept and not got[119].base_failed and got[119].host_failed
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(20), 200]
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_hosts_by_salted_join(spark, monkeypatch):
    from ordina.llm import _store

    monkeypatch.setattr(_store, "BROADCAST_KEYS", 0)
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("h"))
    got = _store.flag(rows, F.col("h"), spark.createDataFrame([("1",), ("9",)], "h string"), "bad").groupBy("h", "bad").count().collect()
    assert {(r.h, r.bad): r["count"] for r in got} == {("0", False): 67, ("1", True): 67, ("2", False): 66}


# --- 2


def brute_cut(texts: list[bytes], length: int = 200) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mark]).astype(int)))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())))
    return out


def kept_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    mark = np.ones(len(text), bool)
    for a, n in spans:
        mark[a : a + n] = False
    return np.frombuffer(text, np.uint8)[mark].tobytes()


def check_cut(docs):
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    spans = brute_cut(texts)
    want = sorted((len(t), sum(n for _, n in s), len(s), hashlib.sha256(kept_of(t, s)).hexdigest()) for t, s in zip(texts, spans))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect()) == want


def test_suffix_dedup_against_brute_force(spark, odd, none):
    check_cut(odd)
    passages = [prose(50 + k, 70) for k in range(3)]
    rng = random.Random(4)
    texts = [prose(100 + k, rng.randint(0, 80)) + passages[k % 3][rng.randint(0, 60) : rng.randint(250, 330)] + prose(200 + k, rng.randint(0, 40)) for k in range(40)]
    texts += ["z" * 450, "z" * 199, "ab" * 150, "q" + "ab" * 120 + "r", "é" * 130, "ü" + "é" * 110]
    check_cut(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4))
    assert suffix_dedup.report(none).count() == 0 and suffix_dedup.strip(none).count() == 0


def test_suffix_dedup_of_cores_with_many_contexts(spark, odd, monkeypatch):
    """Cores beyond the bound take the other way, to the same result."""
    monkeypatch.setattr(suffix_dedup, "MOST", 1)
    check_cut(odd)
    passage = prose(9, 45)
    check_cut(spark.createDataFrame([(k, prose(k, 5 + k) + passage + prose(90 + k, 30)) for k in range(30)], "doc_id long, text string"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=40).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=8), st.integers(8, 33))
def test_suffix_order(texts, length):
    buf = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.arange(max(0, len(buf) - length + 1))
    order, same = suffix_dedup.suffix_order(buf, starts, length)
    strings = [buf[k : k + length].tobytes() for k in starts]
    assert order.tolist() == sorted(range(len(strings)), key=lambda k: (strings[k], k))
    assert same.tolist() == [k > 0 and strings[order[k]] == strings[order[k - 1]] for k in range(len(order))]


def test_cores_stay_whole_over_batches():
    rows = [(core, 10 * core + k, 0, True, bytes([core] * 3 + [k % 2]) * 60) for core in range(6) for k in range(4)]
    table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["core", "g", "lo", "open", "context"])
    want = Counter((g, at) for core, g, _, _, c in rows for at in range(len(c) - 199) if sum(c[at : at + 200] == d[j : j + 200] for x, _, _, _, d in rows if x == core for j in range(len(d) - 199)) > 1)
    for size in (1, 3, 24):
        for together in (1, 1000, 1 << 20):
            suffix_dedup.TOGETHER, old = together, suffix_dedup.TOGETHER
            try:
                found = [r for b in suffix_dedup._ordered((table.slice(k, size) for k in range(0, 24, size)), 200) for r in zip(*(c.to_pylist() for c in b.columns))]
            finally:
                suffix_dedup.TOGETHER = old
            assert Counter(found) == want


def parsed_alone(text: bytes) -> tuple[pa.RecordBatch, pa.ListArray]:
    """What the first step makes of one text, and its phrases as spans that are all to be decided."""
    row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.decode()]), pa.array([1]), pa.array([2])], names=["doc_id", "text", "t1", "t2"])
    (out,) = suffix_dedup._parse(iter([row]), 200)
    found = out.column("phrases")
    core, _, lo, n = found.values.flatten()
    spans = pa.StructArray.from_arrays([lo, n, pa.array(np.full(len(lo), suffix_dedup.OPEN, np.int32)), core], names=["lo", "n", "kind", "core"])
    return out, pa.RecordBatch.from_arrays([pa.array([5]), row.column("text"), pa.ListArray.from_arrays(found.offsets, spans)], names=["g", "text", "spans"])


def test_long_texts_by_windows_have_the_same_phrases(monkeypatch):
    """Windows and groups of contexts of any size give what the whole text gives."""
    names = ["core", "g", "lo", "open", "context"]
    for text in (prose(31, 900).encode(), b"x" * 1500, b"ab" * 700, ("é" * 400 + "日本語" + prose(32, 90)).encode(), prose(33, 100).encode() * 3, b"short", b""):
        whole = suffix_dedup.phrases(_text.Bytes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0))
        assert sum(whole[1].tolist()) == max(0, len(text) - 199)
        want, rows = parsed_alone(text)
        entries = pa.Table.from_batches(list(suffix_dedup._entries(iter([rows]), 200)))
        for size in (400, 401, 777):
            monkeypatch.setattr(suffix_dedup, "WINDOW", size)
            monkeypatch.setattr(suffix_dedup, "CONTEXTS", size)
            found, _ = parsed_alone(text)
            assert found.equals(want)
            assert found.column("phrases").values.field("lo").to_pylist() == whole[0].tolist()
            assert found.column("phrases").values.field("n").to_pylist() == whole[1].tolist()
            some = list(suffix_dedup._entries(iter([rows]), 200))
            assert pa.Table.from_batches(some).select(names).combine_chunks().equals(entries.select(names).combine_chunks())
            assert all(sum(map(len, b.column("context").to_pylist())) < size + 600 for b in some)
        monkeypatch.undo()


def test_long_texts_take_bounded_memory():
    """A worker's memory does not grow with a text's length by more than a few bytes for each of its bytes."""
    text = prose(34, 1_200_000).encode()
    assert len(text) > 5 << 20
    list(suffix_dedup._entries(iter([parsed_alone(text[: 2 << 20])[1]]), 200))  # the tables of powers
    tracemalloc.start()
    try:
        _, rows = parsed_alone(text)
        parse = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        many = sum(b.num_rows for b in suffix_dedup._entries(iter([rows]), 200))
        cut = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert many == len(rows.column("spans").values)
    assert max(parse, cut) < 150 << 20, (parse, cut)


def test_suffix_dedup_strips_texts(odd):
    out = suffix_dedup.strip(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = odd.collect()
    texts = [(r.text or "").encode() for r in rows]
    want = Counter(kept_of(t, s).decode("utf-8", "ignore") if r.text is not None else None for r, t, s in zip(rows, texts, brute_cut(texts)))
    assert Counter(r[1] for r in out.collect()) == want


# --- 3 and 7


def ids_of(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizer():
    texts = ["a   b ΣΑΣ İI ǅ <|endoftext|> é don't I'LL x's 12½ \x01\x1c\x85 日本語 ﬁ ŉ ſ", "", " \n", prose(1, 300), "l'été e\u0301te\u0301 naïve ÀÉÎ Straße ñandú 4,5% ..!?"]
    rng = random.Random(3)
    texts += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñß.,'0123ABC") for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    got = []
    for text, cache, place, n, count in word_ids(pa.array(texts), default_tokenizer()):
        flat, edge = cache.flat[_text.runs(place, n)], np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(count)
        got += [flat[edge[e - c] : edge[e]].tolist() for e, c in zip(ends, count)]
    assert got == [ids_of(t) for t in texts]


def test_token_histogram(odd, none):
    sizes = sorted(len(ids_of(r.text)) for r in odd.collect())
    hist = token_counts.token_histogram(odd).cache()
    rows = {r.n_tokens: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(sizes))
    for size, r in rows.items():
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_tokens) == (sizes.count(size), sum(s > size for s in sizes), sum(s for s in sizes if s > size), sum(sizes))
        assert r.truncated_total == sum(min(s, size) for s in sizes) and r.docs_to == sum(s <= size for s in sizes)
    for limit in (0, 1, 50, 10**6):
        assert token_counts.truncated_total(hist, limit) == sum(min(s, limit) for s in sizes)
    assert token_counts.quantile(hist, 0.5) == sizes[-(-len(sizes) // 2) - 1]
    assert token_counts.token_histogram(none).count() == 0


def best_fit_decreasing(lengths: list[int], context: int) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(context - n)
    return len(gaps)


def supersteps(lengths: list[int], context: int, ranges: int, rng: random.Random) -> tuple[list[tuple], int]:
    """Placements and the number of sequences, by the operator's own sweeps over any cuts of the order, without Spark."""
    rank, runs = 0, []
    for size, n in sorted(Counter(lengths).items(), reverse=True):
        runs.append((best_fit.PIECE, size, rank, n, 0, 0, 0))
        rank += n
    rows = lambda batches: [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    order = lambda r: (-r[1], r[0], -r[2] if r[0] == best_fit.GAP else r[2])
    state, placed = [], []
    for low, high in best_fit.bands(context):
        gaps = [(best_fit.GAP if r[1] > low else best_fit.DONE, *r[1:4], max(1, r[1] // high), *r[5:]) if r[0] == best_fit.GAP else r for r in state]
        todo = sorted([*gaps, *(r for r in runs if low < r[1] <= high)], key=order)
        cuts = sorted(rng.choices(range(len(todo) + 1), k=ranges - 1))
        swept = [r for a, b in zip([0, *cuts], [*cuts, len(todo)], strict=True) for r in rows(best_fit._ranges([best_fit._batch(todo[a:b])], context))]
        state = rows(best_fit._across([best_fit._batch(sorted(swept, key=order))], context))
        placed += [r for r in state if r[0] == best_fit.PLACED]
        state = [r for r in state if r[0] != best_fit.PLACED]
    return sorted((r[2], r[3], r[1], r[5], r[6]) for r in placed), sum(r[3] for r in state if r[0] == best_fit.OPENED)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.integers(1, 5), st.randoms(use_true_random=False))
def test_supersteps_fill_without_gaps(lengths, ranges, rng):
    placed, opened = supersteps(lengths, 40, ranges, rng)
    filled, ranks, order = defaultdict(list), [], sorted(lengths, reverse=True)
    for first, n, size, offset, sequence in placed:
        assert order[first : first + n] == [size] * n
        ranks += range(first, first + n)
        for k in range(n):
            filled[sequence + k].append((offset, size))
    assert sorted(ranks) == list(range(len(lengths))) and sorted(filled) == list(range(opened))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert opened <= best_fit_decreasing(lengths, 40) * 1.1 + 1


@pytest.mark.parametrize("kind", ["short", "middle", "skewed"])
def test_supersteps_need_about_as_many_sequences_as_best_fit_decreasing(kind):
    rng = random.Random(kind)
    draw = {"short": lambda: rng.randint(1, 700), "middle": lambda: rng.randint(300, 1400), "skewed": lambda: 2048 if rng.random() < 0.3 else min(2048, 1 + int(rng.expovariate(1 / 300)))}[kind]
    lengths = [draw() for _ in range(4000)]
    one, opened = supersteps(lengths, 2048, 1, rng)
    least = best_fit_decreasing(lengths, 2048)
    assert least <= opened * 1.001 + 1 and opened <= least * 1.005 + 2

    def places(placed):
        return sorted((first + k, offset, sequence + k) for first, n, _, offset, sequence in placed for k in range(n))

    assert places(supersteps(lengths, 2048, 6, rng)[0]) == places(one)  # the cuts of the ranges change nothing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 9), max_size=12), st.lists(st.integers(4, 30), max_size=8))
def test_a_sweep_gives_each_piece_the_smallest_gap(lengths, sizes):
    runs = sorted([(best_fit.GAP, g, k, 1, max(1, g // 9), 100 - g, 0) for k, g in enumerate(sizes)] + [(best_fit.PIECE, n, k, 1, 0, 0, 0) for k, n in enumerate(lengths)], key=lambda r: (-r[1], r[0], -r[2] if r[0] == best_fit.GAP else r[2]))
    placed, _, _ = best_fit.sweep(runs, 100)
    left = {k: [g, max(1, g // 9), 100 - g] for k, g in enumerate(sizes)}
    want = []
    for n, k in sorted((-n, k) for k, n in enumerate(lengths)):
        fits = [(g, j) for j, (g, units, _) in left.items() if g >= -n and units]
        if fits:
            _, j = min(fits)
            want.append((k, left[j][2], j))
            left[j][1:] = [left[j][1] - 1, left[j][2] - n]
    assert sorted((r[2], r[5], r[6]) for r in placed) == sorted(want)


def test_packing(odd, none):
    rows = best_fit.pack_documents(odd, context=256).collect()
    want = []
    for r in odd.collect():
        ids = np.array([*ids_of(r.text), 0], "<u4")
        want += [(r.doc_id, k, 256 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 256)) if len(p := ids[256 * k : 256 * k + 256])]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) == best_fit_decreasing([r.length for r in rows], 256)
    assert best_fit.pack_documents(none).count() == 0


# --- 4


ODD_TEXTS = ["", " ", "  a  b\n\tc ﬁ é́", "日本語のテキスト", "a" * 300, "x" * 70 + " yyy", "        if x:\n            return  ", "▁▁a▁b", "\x00 a\x00", "😀😀 ok", "ß" * 90 + "日本", " " * 40, "a" + " " * 17 + "b", None, "<s> </s> <0x0A> <unk>", "hello    world   .", "    日本", "  \x01x", "   ▁"]


@pytest.fixture(scope="module")
def vocabulary():
    return piece_lattice.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_lattice.default_model())


def test_lattice_equals_the_library(vocabulary, library):
    texts = [*ODD_TEXTS, prose(1, 500)]
    encoder = piece_lattice.Encoder(vocabulary)
    ids = encoder.encode(pa.array(texts))
    assert ids.to_pylist() == [None if t is None else library.encode(t) for t in texts]
    assert piece_lattice.decode_ids(ids, vocabulary).to_pylist() == [None if t is None else t.replace("▁", " ") for t in texts]
    assert encoder.encode(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcdeino rst.,éñ日\n▁0", max_size=60), min_size=1, max_size=4))
def test_lattice_on_random_texts(vocabulary, library, texts):
    assert piece_lattice.Encoder(vocabulary).encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_lattice_query(odd, none, vocabulary, library):
    rows = piece_lattice.digest(odd, vocabulary).collect()
    assert all(r.round_trip for r in rows)
    want = Counter(zlib.crc32(np.array(library.encode(r.text) if r.text else [], "<u4").tobytes()) for r in odd.collect())
    assert Counter(r.ids_crc32 for r in rows) == want
    assert piece_lattice.digest(none, vocabulary).count() == 0


# --- 5


def test_vector_tree(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[200:700] = x[200]  # a vector that a third of the rows share
    rows = [(int(k), v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (5400, [1.0] * 3, 1), (None, [1.0] * 16, 1), rows[3], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    how = vector_tree.Index(leaf=32, part=100, block=4)
    got = defaultdict(list)
    for r in vector_tree.search(df, F.col("vec_id") % 100 == 0, how=how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 10 and found == sorted(found, key=lambda p: (p[1], p[0]))
        assert np.allclose([s for _, s in found], d[[v for v, _ in found]])
    assert hits >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[300]] == list(range(200, 210))
    few = vector_tree.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert vector_tree.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_vector_tree_of_clusters(spark, none):
    """Clustered vectors, an id with two vectors, clashing columns: recall against brute force."""
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 1, 12)) * 5 + rng.standard_normal((40, 60, 12))).reshape(-1, 12).astype(np.float32)
    rows = [(int(k), v.tolist(), 1, "a", 0) for k, v in enumerate(x)]
    twice = (100 * x[0] + 1).tolist()
    rows += [(7, twice, 1, "b", 0), (7, twice, 1, "b", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, Vec_ID_ string, count long")
    x[7] = min(x[7].tolist(), twice)
    y, hits = x.astype(float), 0
    got = vector_tree.search(df, F.col("vec_id") % 100 == 0, how=vector_tree.Index(leaf=16, first=2, sample=1500)).collect()
    for q in range(0, 2400, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert len(found) == len({v for _, v in found}) == 10 and np.allclose([s for s, _ in found], d[[v for _, v in found]])
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {v for _, v in found})
    assert hits >= 0.9 * 240


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 12), st.integers(1, 5))
def test_within(seed, n, m, k):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(0, 3, (n, 2)).astype(float), rng.permutation(n)
    q, own, radius = rng.integers(0, 3, (m, 2)).astype(float), rng.integers(0, n, m), rng.choice([0.0, 1.0, 1.5, np.inf], m)
    i, j, d = vector_tree.within(q, own, radius, x, ids, k)
    for a in range(m):
        exact = vector_tree.distances(q[a], x)
        want = sorted((exact[b], ids[b]) for b in range(n) if ids[b] != own[a] and exact[b] <= radius[a])[:k]
        assert [(s, ids[b]) for s, b in zip(d[i == a], j[i == a])] == want


# --- 6 and 8


def test_language_id(spark, odd, none):
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(40))
    kinds = {"en": ["the", "ing", "th", "er"], "de": ["sch", "ung", "ä", "keit"], "fr": ["eau", "que", "é", "oi"]}
    rows = [(k, make(kinds[v]), v) for k in range(240) for v in [list(kinds)[k % 3]]]
    rows += [(1000, None, "en"), (1001, "12 .. 3", "de"), (1002, "日本", None), (None, make(kinds["en"]), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == r.held_out for k, r in by.items() if k is not None)
    held = [k for k in range(240) if by[k].held_out]
    assert np.mean([by[k].lang_pred == rows[k][2] for k in held]) >= 0.95
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1002].lang_pred in kinds
    assert language_id.identify(odd).count() == odd.count()
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}


def test_byte_cnn(spark, odd, none):
    labels = [(k, int(k % 3 != 0), 0) for k in range(300)]
    docs = spark.createDataFrame([(k, prose(k, 60) if q else prose(k, 30).upper().replace(" ", "!! "), "en", "s", 0, None, None, None) for k, q, _ in labels], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    net = byte_cnn.train(docs, marks, byte_cnn.Training(per_class=100, epochs=6))
    rows = {r.doc_id: r for r in byte_cnn.classify(docs, net).collect()}
    held = [k for k, _, _ in labels if rows[k].held_out]
    assert np.mean([rows[k].predicted == int(k % 3 != 0) for k in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    kept = byte_cnn.keep(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.predicted}
    assert byte_cnn.classify(odd, net).count() == odd.count() and byte_cnn.classify(none, net).count() == 0
    assert byte_cnn.train(none, marks.where("false")) is None
    assert {r.score for r in byte_cnn.classify(odd, None).collect()} == {0.5}


def test_byte_cnn_parts_agree():
    net = byte_cnn.Net(*(np.random.default_rng(1).standard_normal(s).astype(np.float32) for s in ((256, 8), (64, 4), (4,), (12,), (1,))))
    texts = [b"", b"a", prose(1, 3000).encode(), b"x" * 255, b"y" * 5000]
    whole = np.concatenate([byte_cnn.score(t, net) for t in _text.parts(pa.array([x.decode() for x in texts]))])
    alone = np.concatenate([byte_cnn.score(t, net) for x in texts for t in _text.parts(pa.array([x.decode()]))])
    assert np.allclose(whole, alone, atol=1e-5)


def slow_score(text: bytes, net: byte_cnn.Net) -> float:
    """The network's forward pass, byte by byte."""
    blocks = -(-(len(text) + byte_cnn.WIDTH) // byte_cnn.BLOCK)
    padded = text + bytes(blocks * byte_cnn.BLOCK + byte_cnn.WIDTH - len(text))
    maxima = []
    for b in range(blocks):
        rows = []
        for at in range(b * byte_cnn.BLOCK, (b + 1) * byte_cnn.BLOCK, byte_cnn.STRIDE):
            window = np.concatenate([net.embed[c] for c in padded[at : at + byte_cnn.WIDTH]])
            rows.append(window @ net.conv)
        maxima.append(np.maximum(np.max(rows, axis=0) + net.bias, 0))
    chunks = [np.maximum(maxima[k], maxima[k + 1]) for k in range(blocks - 1)] or [maxima[0]]
    x = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0), np.min(chunks, axis=0)])
    return float(1 / (1 + np.exp(-(x @ net.out + net.base[0]))))


def test_byte_cnn_against_loops():
    rng = np.random.default_rng(7)
    dims = 4
    net = byte_cnn.Net(*(rng.standard_normal(s).astype(np.float32) * 0.3 for s in ((256, dims), (byte_cnn.WIDTH * dims, 5), (5,), (15,), (1,))))
    texts = ["", "a", "é" * 100, prose(1, 300), "x" * byte_cnn.BLOCK, "y" * (3 * byte_cnn.BLOCK + 1)]
    got = np.concatenate([byte_cnn.score(t, net) for t in _text.parts(pa.array(texts))])
    assert np.allclose(got, [slow_score(t.encode(), net) for t in texts], atol=1e-4)


def test_subwords_against_loops():
    """Buckets of all byte trigrams and all words of each text, none across texts."""
    texts = ["", "ab", "abc", "The cat. the CAT", "é日本 x", "a" * 500, " \t"]
    tri, n_tri, words, n_words = language_id.subwords(next(_text.parts(pa.array(texts))))
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()) for t in texts]
    assert n_tri.tolist() == [max(0, len(t) - 2) for t in low] and n_words.tolist() == [len(words_of) for words_of in map(words_in, low)]
    code = lambda a, b, c: ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F & 0xFFFFFFFF) >> 20
    assert tri.tolist() == [code(*t[k : k + 3]) for t in low for k in range(len(t) - 2)]
    names = [w for t in low for w in words_in(t)]
    bucket = dict(zip(names, words.tolist()))
    assert [bucket[w] for w in names] == words.tolist() and all(language_id.TRIGRAMS <= b < language_id.BUCKETS for b in words.tolist())


def words_in(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", text)


def test_language_prediction_and_rejection():
    """Logits are the average of the subwords' rows; a score below the calibrated one is rejected."""
    rng = np.random.default_rng(0)
    model = language_id.Model(("a", "b", "c"), rng.standard_normal((language_id.BUCKETS, 3)).astype(np.float32) * 3, np.array([0.1, 0, -0.1], np.float32), 1.5, 0.6)
    texts = [prose(k, 1 + 3 * k) for k in range(12)]
    got = language_id._predict(pa.array([*texts, None, "12 3", ""]), model).to_pylist()
    for text, r in zip(texts, got):
        tri, _, words, _ = language_id.subwords(next(_text.parts(pa.array([text]))))
        z = (model.logits[[*tri, *words]].mean(axis=0) + model.bias) / model.temperature
        q = np.exp(z) / np.exp(z).sum()
        assert r["lang_pred"] == "abc"[int(q.argmax())] and np.isclose(r["score"], q.max(), atol=1e-5) and r["rejected"] == bool(q.max() < 0.6)
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in got[len(texts) :])


def test_rejection_is_calibrated():
    """Among rows that calibration keeps, the asked share is right, although a fifth of the labels are wrong."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 900)
    x = np.zeros((900, language_id.BUCKETS), np.float32)
    plain = rng.random(900) < 0.2  # rows that tell nothing of their label
    for i, k in enumerate(y):
        x[i, rng.choice(30, 8) + (100 if plain[i] else 200 + 30 * k)] += 1 / 8
    model = language_id.fit(x[:600], y[:600], ("a", "b", "c"), language_id.Training(precision=0.95))
    p = language_id.softmax((x[600:] @ model.logits + model.bias) / model.temperature)
    kept = p.max(axis=1) >= model.least_score
    assert (p.argmax(axis=1) == y[600:])[kept].mean() >= 0.9 and kept[~plain[600:]].mean() > 0.7 and kept[plain[600:]].mean() < 0.4


def test_every_language_is_learned(spark):
    """A rare language among many is told too; the sample is bounded in all."""
    kinds = {f"l{k}": [f"{c}{d}" for c in "bcdfgh" for d in "aeiou"][k % 25 : k % 25 + 4] + [chr(0x250 + k) * 2] for k in range(80)}
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choices(kinds[v], k=3)) for _ in range(25)), v) for k in range(1200) for v in [f"l{k % 80}"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, language_id.Training(documents=800, epochs=2))
    assert model.labels == tuple(sorted(kinds))


# --- 9


def test_link_rank(spark):
    html = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    pages = [
        (1, "https://A.example.com/en/1?x=1", html("/a", "https://b.example.com/")), (2, "https://a.example.com/en/7/2", None), (3, "http://x.net/de/5#f", ""), (4, "http://sub.example.net/de/81", None),
        (5, "https://bad.com/en/1", None), (6, "https://bad.com/en/2", None), (7, "https://bad.com/fr/2", html("https://friend.io/")), (8, "https://friend.io/", html("https://bad.com/en/1", "//bad.com/x")), (9, None, None), (10, "no scheme", None), (11, "http://org/es/", None), (12, "https://bad.com/en/1", None),
    ]
    df = spark.createDataFrame([(*p, "x") for p in [*pages, pages[2]]], "page_id long, url string, html string, Host string")
    got = {r.page_id: r for r in link_rank.judge(df).collect()}
    assert link_rank.judge(df).count() == 13
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/7", "allow")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("x.net", "/de/5", "net/de/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.net/de/8", "block")
    assert (got[7].rule, got[7].verdict) == (None, "block") and got[7].host_blocked
    assert got[8].verdict == "block"  # distrust flows back along its links
    assert (got[9].host, got[9].path, got[9].rule, got[9].verdict) == ("", "", None, "allow") == (got[10].host, got[10].path, got[10].rule, got[10].verdict)
    assert got[11].rule == "org/es/"
    assert link_rank.judge(df.where("false")).count() == 0
    plan = link_rank.judge(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_link_rank_sql(spark, tmp_path):
    import duckdb

    hosts = [f"h{k}.example.{t}" for k, t in enumerate(["com", "net", "org"] * 4)]
    rng = random.Random(1)
    rows = [(k, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 99)}", " ".join(f'<a href="https://{rng.choice(hosts)}/">' for _ in range(rng.randint(0, 4)))) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = df.toPandas()  # noqa: F841
    want = duckdb.sql(link_rank.judge_sql()).fetchall()
    assert sorted(map(tuple, link_rank.judge(df).select("page_id", "host", "path", "rule", "verdict", "host_blocked").collect())) == sorted(want)


# --- 10


def brute_links(texts: list[str | None]) -> tuple[list[int], list[int]]:
    sets = []
    for t in texts:
        w = words(t)
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(k) for k in range(len(texts))]


def near_copies() -> list[str | None]:
    rng, out = random.Random(8), []
    for k in range(12):
        base = prose(k, 150).split(" ")
        out += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 99))
            out.append(" ".join(w))
    return [*out, None, "", "a b", "a b", "one two three four five", "one two three four five six"]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_join_against_brute_force(spark, block):
    texts = near_copies()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard_join.join(df, jaccard_join.Join(block=block)).collect()}
    links, classes = brute_links(texts)
    assert [got[k].n_links for k in range(len(texts))] == links
    assert [got[k].class_id for k in range(len(texts))] == classes
    kept = jaccard_join.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))


def test_jaccard_join_odd_rows(odd, none):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count()
    copies = [r for r in got if r.doc_id in (5, 6, 7, 17)]
    assert {r.class_id for r in copies} == {5} and {r.n_links for r in copies} == {5}
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and not {6, 7, 17} & set(ids) and ids[None] == 2 and ids[0] == ids[1] == ids[2] == 1
    assert jaccard_join.join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Unlike texts under one id stay, near and exact copies under one id are one."""
    one, two, three = prose(301, 60), prose(302, 60), prose(303, 60)
    near = one.replace(one.split(" ")[30], "changed", 1)
    rows = [(1, one), (1, two), (1, near), (1, one), (2, two), (3, three), (3, near), (4, None), (4, None), (None, three)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.text if r.text in (None, two, three) else "one") for r in kept)
    assert found == {(1, "one"): 1, (1, two): 1, (3, three): 1, (4, None): 2, (None, three): 1}


def test_large_clusters_meet_by_bands(spark):
    """Chains of near copies far longer than a block: links and classes against brute force."""
    base = prose(400, 90).split(" ")
    texts = []
    for k in range(60):  # each differs from the one before in a word, so ends of the chain have little in common
        base[(k * 7) % len(base)] = f"w{k}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard_join.join(df, jaccard_join.Join(block=4)).collect()}
    links, classes = brute_links(texts)
    assert [got[k].n_links for k in range(60)] == links and [got[k].class_id for k in range(60)] == classes


def test_near_copies_have_few_blocks(spark, monkeypatch):
    """Texts that are all alike, but for a few words of their own, fall into about as many blocks as their number asks for."""
    base, rng, met = prose(401, 80).split(" "), np.random.default_rng(5), {}

    def counted(df, name, write=jaccard_join.durable):
        out = write(df, name)
        met[name] = out.count()
        return out

    texts = []
    for k in range(240):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(1, 4)), replace=False):
            words[at] = f"w{k}"
        texts.append(" ".join(words))
    monkeypatch.setattr(jaccard_join, "durable", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard_join.join(df, jaccard_join.Join(block=16)).collect()}
    links, classes = brute_links(texts)
    assert [got[k].n_links for k in range(240)] == links and [got[k].class_id for k in range(240)] == classes
    assert met["jaccard-meets"] < 600  # 15 blocks of 16 have 120 pairs; small blocks add some


def test_pruning_keeps_pairs_at_the_threshold():
    how = jaccard_join.Join()
    least = jaccard_join.least_agreements(how)
    rng = np.random.default_rng(0)
    agree = rng.random((200_000, how.size)) < how.threshold
    alive = np.ones(len(agree), bool)
    for n in range(how.step, how.size + 1, how.step):
        alive &= agree[:, :n].sum(axis=1) >= least[n]
    assert (~alive).mean() < 1e-3
    unlike = rng.random((20_000, how.size)) < 0.3
    assert (unlike[:, : how.step].sum(axis=1) >= least[how.step]).mean() < 0.6


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 20)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "x long, y long"), "test").collect()}
    assert all(got.get(v, v) == find(v) for v in root)


# --- the pipeline


def test_stages(spark, odd, none, tmp_path):
    """Each stage against what its operator's brute-force version says of the odd rows."""
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(18)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    stage = {n: lambda docs, f=f: f(spark, docs, str(tmp_path)) for n, f in corpus_pipeline.STAGES}
    out = {n: f(odd) for n, f in stage.items()}
    for name, f in stage.items():
        if name != "best-fit packing":
            assert out[name].schema == odd.schema and f(none).schema == none.schema
        assert f(none).count() == 0
    rows = odd.collect()
    as_is = Counter(tuple(r) for r in rows)
    kept = {n: Counter(tuple(r) for r in out[n].collect()) for n in list(stage)[:-1]}
    net = byte_cnn.train(odd, labels)
    scores = {r.text or "": float(byte_cnn.score(next(_text.parts(pa.array([r.text or ""]))), net)[0]) for r in rows}
    assert kept["quality classifier"] == Counter(tuple(r) for r in rows if scores[r.text or ""] >= 0.3)
    good = {r.doc_id for r in quality_rules.judge(odd).collect() if r.kept and r.doc_id is not None}
    assert {r[0] for r in kept["quality rules"]} - {None} == good and not kept["quality rules"] - as_is
    ids = Counter(r[0] for r in kept["n-gram Jaccard join"].elements())
    assert ids[5] == 1 and not {6, 7, 17} & set(ids) and all(ids[k] == 1 for k in (0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14, 15, 16)) and not kept["n-gram Jaccard join"] - as_is
    texts = [(r.text or "").encode() for r in rows]
    cut = [kept_of(t, s).decode("utf-8", "ignore") if r.text is not None else None for r, t, s in zip(rows, texts, brute_cut(texts))]
    assert kept["suffix-array dedup"] == Counter((r[0], c, *r[2:]) for r, c in zip(rows, cut))
    pieces = out["best-fit packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in rows)


def test_texts_beyond_a_chunk(spark):
    """Texts of more bytes than are handled at once come alone and whole."""
    body = prose(77, 260_000)
    assert len(body) > _text.CHUNK
    texts = [body, "short text here", body[:-2000] + prose(78, 300), "é" * 600_000]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [judged[k].n_words for k in range(4)] == [len(words(t)) for t in texts] and judged[3].word_chars == 600_000
    cut = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    assert [cut[k].n_bytes for k in range(4)] == [len(t.encode()) for t in texts] and cut[0].n_removed >= len(body) - 2300 and cut[1].n_removed == 0
    packed = Counter()
    for r in best_fit.pack_documents(docs.where("doc_id < 2")).collect():
        packed[r.doc_id] += r.length
    assert packed[0] > 200_000 and packed[1] < 20
    linked = {r.doc_id: r.class_id for r in jaccard_join.join(docs).collect()}
    assert linked == {0: 0, 1: 1, 2: 0, 3: 3}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}[0] == "en"


def test_pipeline_is_its_stages(spark, tmp_path):
    good = [prose(k, 80) for k in range(30)]
    bad = [prose(500 + k, 40).upper().replace(" ", "!! ") for k in range(20)]
    texts = [*good, *bad, good[0], good[1] + " more", prose(900, 10), ("again and again " * 30)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 30), 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(ids & set(range(30))) >= 29 and not ids & {50, 51, 52, 53} and len(ids & set(range(30, 50))) <= 1
