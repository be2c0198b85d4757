"""Corpus operators against plain Python, and on awkward input."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import (
    common, decontaminate, exact_dedup, fm_index, graphs, html_consensus, jaccard_join, language_crf, packing, quote_links,
    repeats, suffix_arrays, url_templates, winnow,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key long, n int, class string, row string, id int"


def vocabulary(seed=1, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=3):
    """Texts with exact, near and partial copies, empty and null ones, ties, repeated rows."""
    rng, words = random.Random(seed), vocabulary()
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 13, 30, 120, 300]))) for _ in range(60)]
    for i in range(30):
        w = texts[rng.randrange(60)].split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append((" " if i % 2 else "\n\t").join(w))
    passage = " ".join(rng.choices(words, k=70))
    texts += [f"{rng.choice(words)} {passage} {' '.join(rng.choices(words, k=20))}" for _ in range(6)]
    texts += ["", "   \n", None, "é " * 70, "x" * 5000, " ".join(rng.choices(words, k=6000)), "123 456 !!", "word word word " * 40]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, "another text of a repeated id"), (None, texts[7]), (None, None), (None, texts[8])]
    return [(d, t, ["en", "de", None][k % 3], 1, 2, "c", "r", 3) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k, words=WORD.findall):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# --- 1


def brute_components(rows, k, share):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                label[root(i)] = root(j)
    small = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            small[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(small[root(i)], default=None) if sets[i] else d)
                   for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "share"), [(4, 85), (2, 70)])
def test_jaccard_join(docs, k, share):
    rows = [(r[0], r[1]) for r in corpus()]
    got = jaccard_join.jaccard_join(docs, k, share).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, k, share)


def test_jaccard_near_copies_of_one_text(spark):
    rng, words = random.Random(5), vocabulary(9)
    base = rng.choices(words, k=120)
    rows = []
    for i in range(80):
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)


def test_small_sets_enumerate_what_they_share():
    for n in range(1, 30):
        for m in jaccard_join.partner_sizes(n, 85):
            k = jaccard_join.overlap(n, m, 85)
            assert 100 * k >= 85 * (n + m - k) and 100 * (k - 1) < 85 * (n + m - k + 1)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(graphs.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200}


def test_small_labels_are_not_written_in_a_file_for_each_partition_of_a_shuffle(spark, monkeypatch):
    seen, write = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: seen.append(df.rdd.getNumPartitions()) or write(df, name))
    with common.setting(spark, "spark.sql.shuffle.partitions", "61"), common.setting(
            spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        got = dict(graphs.components(spark.createDataFrame([(3, 2), (2, 1), (2, 1)], "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1}
    assert max(seen) <= spark.sparkContext.defaultParallelism < 61


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """500 copies of one text, half of them just under the threshold: few pairs are compared, no link is lost."""
    rng, words = random.Random(12), [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for k in range(500):
        w = list(words)
        for p in rng.sample(range(1, 74), 6 + k % 2):
            w[4 * p] = f"x{rng.random()}"
        texts.append(" ".join(w))
    compared = []
    plain = jaccard_join.compare

    def counted(pairs, own, share):
        out = plain(pairs, own, share)
        compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "compare", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: 0 if i % 2 or not i else i for i in range(501)}
    assert sum(compared) < 5_000


def test_links_that_hubs_miss_are_found_without_comparing_all_pairs(spark, monkeypatch):
    """400 variants of one text, each with 8 of 20 edits; a link needs 5 in common, so each has few links and they form one class."""
    rng, words = random.Random(3), [f"w{i}" for i in range(300)]
    edits = [tuple(sorted(rng.sample(range(20), 8))) for _ in range(400)]
    texts = []
    for own in edits:
        w = list(words)
        for e in own:
            w[12 * e + 8] = f"x{e}"
        texts.append(" ".join(w))
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(400), 2):
        if len({*edits[i]} & {*edits[j]}) >= 5:
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    compared, met = [], []
    plain, pairs = jaccard_join.compare, jaccard_join.pairs_across

    def counted(*args):
        out = plain(*args)
        compared.append(out.count())
        return out

    def meeting(*args):
        out = pairs(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "compare", counted)
    monkeypatch.setattr(jaccard_join, "pairs_across", meeting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: root(i) for i in range(400)}
    assert sum(compared) < 20_000 and max(met) < 500_000


def test_links_are_followed_once_and_only_between_components(spark, monkeypatch):
    """Rounds that link one group over and over do not read the links of earlier rounds again."""
    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(90):
        w = list(words)
        for e in rng.sample(range(20), 8):
            w[12 * e + 8] = f"x{e}"
        texts.append(" ".join(w))
    linked, followed = [], []
    plain, found = jaccard_join.compare, jaccard_join.components

    def counted(*args):
        out = plain(*args)
        linked.append(out.filter("linked").count())
        return out

    def following(links):
        followed.append(links.count())
        return found(links)

    monkeypatch.setattr(jaccard_join, "compare", counted)
    monkeypatch.setattr(jaccard_join, "components", following)
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    assert len(linked) > 2 and sum(followed) <= sum(linked)


def test_components_are_merged_by_new_links(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 9)], "key long, comp long")
    links = spark.createDataFrame([(2, 6), (1, 5), (1, 2), (8, 9)], "a long, b long")
    assert dict(jaccard_join.merged(comps, links).collect()) == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


# --- 2


def test_exact_dedup(docs):
    rows = {(d, t or "") for d, t, *_ in corpus()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((d, t))
    want = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        ids = {d for d, _ in own}
        want += [(d, keep, len({(x, re.sub(r"\s", "", y)) for x, y in own}), d == keep, hashlib.sha256(norm.encode()).hexdigest())
                 for d in ids]
    index = exact_dedup.fresh_index(docs.sparkSession, docs)
    got = exact_dedup.exact_dedup(docs, index, "a").drop("n_rows").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_index_keeps_what_came_first(spark):
    one = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "ab"), (2, "d"), (3, "d ")], "doc_id long, text string")
    index = exact_dedup.fresh_index(spark, one)
    exact_dedup.exact_dedup(one, index, "one").collect()
    for _ in range(2):  # a batch that is run again gives the same
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, index, "two").collect()}
        assert got == {1: (5, False), 2: (3, False), 3: (3, True)}
    assert index.rows().count() == 3


# --- 3


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, jumps = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    both, pairs = language_crf.marginals(scores, np.array([True, False, False, True]), jumps)
    total, want, moves = 0, np.zeros((3, 3)), np.zeros((3, 3))
    for y in np.ndindex(3, 3, 3):
        p = np.exp(sum(scores[i, y[i]] for i in range(3)) + jumps[y[0], y[1]] + jumps[y[1], y[2]])
        total += p
        for i in range(3):
            want[i, y[i]] += p
        moves[y[0], y[1]] += p
        moves[y[1], y[2]] += p
    assert np.allclose(both[:3], want / total)
    assert np.allclose(pairs, moves / total)
    assert np.allclose(both[3], np.exp(scores[3]) / np.exp(scores[3]).sum())


def test_language_id(spark):
    rng, a, b = random.Random(2), vocabulary(11), ["ß" + w.upper() for w in vocabulary(12)]
    rows = [(i, " ".join(rng.choices((a, b)[i % 2], k=30)) + ".", ("aa", "bb")[i % 2]) for i in range(200)]
    rows += [(900, None, "aa"), (901, "12 %% 34", "bb"), (902, "", None), (None, " ".join(a[:9]), None), (903, " ".join(a[:20] + b[:20]), None)]
    got = {r.doc_id: r for r in language_crf.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert [(s.lang, s.words) for s in got[903].spans] == [("aa", 20), ("bb", 20)]
    assert got[None].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("mixed", [3, 4])
def test_documents_of_many_languages_are_kept(spark, mixed):
    letters = ("abcde", "fghij", "klmno", "pqrst")
    rng, langs = random.Random(5), ("aa", "bb", "cc", "dd")[:mixed]
    words = {x: ["".join(rng.choices(letters[k], k=rng.randint(3, 7))) for _ in range(200)] for k, x in enumerate(langs)}
    rows = [(i, " ".join(rng.choices(words[x], k=30)) + ".", x) for i in range(40) for x in langs]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    switched = " ".join(" ".join(rng.choices(words[x], k=20)) + "." for x in langs)
    rows += [(900, switched, None), (901, "12 %% 34", None)]
    kept = language_crf.keep_languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {901}


def test_languages_of_a_large_batch_take_little_memory_at_once(spark, monkeypatch):
    rng, words = random.Random(2), vocabulary(n=3000)
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(40)), "text": [". ".join(" ".join(rng.choices(words, k=20)) for _ in range(600)) for _ in range(40)]})
    model = language_crf.fit([t[:3000] for t in batch.column("text").to_pylist()[:4]], ["a", "b", "c", "d"])
    taken = []
    rows = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    language_crf.identify(rows, model, ("lang", "score"))
    tracemalloc.start()
    try:
        said = sum(b.num_rows for b in taken[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert said == 40 and batch.nbytes > 2_000_000
    assert peak < 40_000_000


def test_language_id_without_labels(docs, empty):
    got = language_crf.language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in got.collect()} == {("und", 0.0)}
    assert language_crf.language_id(empty).count() == 0


# --- 4


def check_packing(rows, texts):
    encode = packing._encoder(packing.TOKENIZER)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for d, t in texts.items():
        ids = [*encode(t or ""), 0]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = np.array(ids[at:at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            assert np.frombuffer(r.ids, "<u2").tolist() == part.tolist()
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in rows)
    return len(sequences) * 1024 - used, used


def test_packing(spark):
    texts = {d: t for d, t, *_ in corpus() if d is not None}
    texts[5] = corpus()[5][1]
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)).collect()
    empty, used = check_packing(rows, texts)
    assert empty < 1024 + 0.02 * used


def test_packing_of_equal_lengths(spark):
    texts = {i: "word " * 599 + "w" for i in range(60)}
    empty, used = check_packing(packing.pack(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)).collect(), texts)
    assert empty < 1024  # cut where a sequence is full


@pytest.mark.parametrize("short", [0, 8])
def test_packing_of_many_short_documents(spark, short):
    nine = "word" + " word" * 7
    assert len(packing._encoder(packing.TOKENIZER)(nine)) == 8
    texts = {i: "word " * 300 + "w" * (i % 7) for i in range(40)} | {100 + i: nine if short else "" for i in range(600)}
    empty, used = check_packing(packing.pack(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)).collect(), texts)
    assert empty < 1024 + 0.02 * used


def test_packing_keeps_repeated_rows(docs, empty):
    got = packing.pack(docs)
    assert got.filter("start = 0").count() == docs.count()
    assert packing.pack(empty).count() == 0


def test_tokens_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing._encoder(packing.TOKENIZER)
    for t in ["", "a b", "Éàß ñ 日本語 🙂🙂", "don't  we'll\n\n\t x ", "<|endoftext|> x", " " * 3000, " " * 1_500_000 + "x", "ab" * 4000, "1234567.89 %%%&&&", "\u00a0\u2003x"]:
        assert encode(t) == whole.encode(t, add_special_tokens=False).ids


# --- 5


def test_quotes_make_replies(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nI have a list."),
        (1, 1, "assistant", "Use sort."),
        (1, 2, "user", "On Monday X wrote:\n> How do I   sort?\n> I have a list.\n\nMe too."),
        (1, 3, "assistant", "> Use sort.\nIt fails.\n> > How do I sort?"),
        (1, 4, "user", "> > Use sort.\n> It fails.\nWhy?"),
        (1, 5, "user", "> never written\nfree"),
        (2, 0, "user", "> How do I sort?\nother thread"),
        (None, 0, "user", "> Use sort."), (2, None, None, None), (1, 1, "assistant", "Use sort."),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quote_links.link_quotes(messages).collect()}
    assert got[1, 2].text == "Me too." and got[1, 3].text == "It fails."
    parents = {k: (r.parent_turn, r.root_turn, r.reply_depth) for k, r in got.items()}
    assert parents[1, 2] == (0, 0, 1) and parents[1, 3] == (1, 1, 1) and parents[1, 4] == (3, 1, 2)
    assert parents[1, 5] == (None, 5, 0) and parents[2, 0] == (None, 0, 0) and parents[None, 0] == (None, 0, 0)
    assert parents[2, None] == (None, None, 0)
    assert got[1, 0].chat == "<|user|>\nHow do I sort?\nI have a list."
    assert quote_links.link_quotes(messages.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, i, "user", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(33)]
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.root_turn, r.reply_depth) == (0, r.turn) for r in got)


# --- 6


@pytest.mark.parametrize("literals", [50_000, 0])
def test_decontamination(docs, spark, literals):
    rows = [(r[0], r[1]) for r in corpus()]
    rng = random.Random(4)
    items = []
    for i in range(12):
        w = (rows[60 + i][1] or "").split()[:rng.choice([4, 6, 12, 25])]
        if i % 3 == 0 and len(w) > 6:
            w[3] = "changed"
        items.append((i, " ".join(w).upper() + "!"))
    items += [(50, None), (51, "too short"), (None, " ".join((rows[20][1] or "").split()[:15])), items[1]]
    find = re.compile(r"[^\W_]+").findall
    want = set()
    for j, q in items:
        q = {s for s in shingles((q or "").lower(), 5, find) if len(s) == 5}
        for d, t in rows:
            if q and len(q & shingles((t or "").lower(), 5, find)) >= 0.8 * len(q) - 1e-9:
                want.add((d, j))
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), literals=literals)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert got.select("doc_id", "item_id", "text_hash").distinct().count() == got.count()
    assert decontaminate.contaminated(docs, docs.selectExpr("doc_id AS item_id", "text").limit(0)).count() == 0


# --- 7 and 8


def brute_repeats(rows, words, length):
    never = 2**63 - 1
    first, out = {}, []
    cut = [(never if d is None else d, d, WORD.findall(t or "") if words else (t or "").encode()) for d, t in rows]
    for i, _, s in cut:
        for k in range(len(s) - length + 1):
            w = tuple(s[k:k + length])
            first[w] = min(first.get(w, never), i)
    for i, d, s in cut:
        gone = set()
        for k in range(len(s) - length + 1):
            if first[tuple(s[k:k + length])] < i:
                gone.update(range(k, k + length))
        kept = [s[k] for k in range(len(s)) if k not in gone]
        kept = " ".join(kept).encode() if words else bytes(kept)
        out.append((d, len(s), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 0])
@pytest.mark.parametrize("words", [True, False])
def test_repeats(docs, words, hot, monkeypatch):
    rows = [(r[0], r[1]) for r in corpus()]
    monkeypatch.setattr(repeats, "SHARD", 3000)
    run = fm_index.substring_dedup if words else suffix_arrays.suffix_array_dedup
    plain = repeats.repeats
    monkeypatch.setattr(fm_index if words else suffix_arrays, "repeats", lambda *a: plain(*a, hot=hot))
    got = run(docs).select("doc_id", "n", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, words, 50)


def test_repeats_of_nothing(empty):
    assert fm_index.substring_dedup(empty).count() == suffix_arrays.suffix_array_dedup(empty).count() == 0


def test_suffix_array_blocks_are_merged():
    rng = random.Random(6)
    bodies = [bytes(rng.choices(b"ab", k=rng.randint(8, 40))) for _ in range(60)]
    windows, first = np.array([len(b) - 7 for b in bodies]), np.array([rng.randrange(1000) for _ in bodies])
    least = {}
    for b, f in zip(bodies, first, strict=True):
        for k in range(len(b) - 7):
            least[b[k:k + 8]] = min(least.get(b[k:k + 8], 10**9), f)
    want = [least[b[k:k + 8]] for b in bodies for k in range(len(b) - 7)]
    for block in (10**9, 200, 40):
        assert suffix_arrays.solve(bodies, windows, first, 8, block).tolist() == want


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 3, 30), 0) for _ in range(20)])
    order = suffix_arrays.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    starts, sizes = np.arange(20) * 31, np.full(20, 31)
    found = suffix_arrays.common_prefixes(text, order, starts, sizes, 12)
    for i in range(1, len(order)):
        a, b = text[order[i - 1]:], text[order[i]:]
        n = min(len(a), len(b), 12)
        same = a[:n] == b[:n]
        assert found[i] == (n if same.all() else same.argmin())


def test_suffixes_refined_to_a_depth_share_ranks_as_they_share_symbols():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 3, 30), 0) for _ in range(20)])
    for depth in (1, 8, 12, 20):
        key = (suffix_arrays.packed(text), suffix_arrays.PACKED) if depth > suffix_arrays.PACKED else (None, 1)
        order, rank = suffix_arrays.refined(text, *key, depth)
        heads = [text[i:i + depth].tolist() for i in range(len(text))]
        assert [heads[i] for i in order] == sorted(heads)
        names = {h: k for k, h in enumerate(sorted({tuple(h) for h in heads}))}
        assert np.unique(rank, return_inverse=True)[1].tolist() == [names[tuple(h)] for h in heads]


def test_fm_index_matches_texts_it_does_not_hold():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 6, 80) for _ in range(5)]
    text, starts, sizes, _, _ = suffix_arrays.laid_out(parts, np.array([1] * 5))
    index = fm_index.FMIndex(text, starts, sizes, 10)
    query = np.concatenate([parts[1][20:50], rng.integers(1, 8, 40), parts[3][60:], rng.integers(1, 6, 30)])
    known = {tuple(p[i:i + 10]) for p in parts for i in range(71)}
    want = [i for i in range(len(query) - 9) if tuple(query[i:i + 10]) in known]
    got = []
    for place, low, high in index.match(query, np.array([0]), np.array([len(query)])):
        got += place.tolist()
        for p, a, b in zip(place, low, high, strict=True):
            assert all((text[s:s + 10] == query[p:p + 10]).all() for s in index.order[a:b]) and b > a
    assert sorted(got) == want


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    grams = winnow.byte_grams(data, 4)
    place, first, last = winnow.anchors(grams, np.array([1500, 3, 2497]), 12, 4)
    of = {s: grams[p] for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)}
    assert sorted(of) == [*range(1489), *range(1503, 3989)]
    seen = {}
    for s, h in of.items():
        assert seen.setdefault(data[s:s + 12].tobytes(), h) == h


def test_anchors_of_bytes_take_little_memory_at_once():
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(1000)] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    unit, seen = repeats.Unit(False, suffix_arrays.ANCHOR), 0
    tracemalloc.start()
    for part, data, starts, ends, _, _, _, first, last in repeats._sliced(batch, unit, 50):
        repeats.slices(data, starts[first], ends[last + 49])
        seen += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) and peak < 150_000_000


# --- 9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></ul></nav><div class="top-banner">Accept cookies</div><!-- x --><div class="content{n}">
<h1>Head &amp; line</h1><p>One <b>two</b><br>three&nbsp;four<p>Five {body}<ul><li>six<li>seven</ul><div class="ad">Buy</div>
<form>mail <input></form></div><aside>side</aside><section id="comments"><p>I disagree</p></section><footer>&copy; foot</footer>"""


def test_html(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(n=i, body="long text " * 20)) for i in range(6)]
    rows += [(10, "http://h.org/x", None), (11, None, ""), (12, "nohost", "just text"), (13, "http://h.org/y", "<p>a</p><script>x"),
             (13, "http://h.org/y", "<p>a</p><script>x"), (14, "http://h.org/z", "<div>" * 3000 + "deep"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("p")).withColumn("host", F.lit(1))
    got = defaultdict(list)
    for r in html_consensus.extract(pages).collect():
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    want = "Head & line\nOne two three four\nFive " + ("long text " * 20).strip() + "\nsix\nseven"
    assert all(got[i][0].text == want for i in range(6))
    assert [got[i][0].text for i in (10, 11, 12, 14, None)] == ["", "", "just text", "deep", ""]
    assert [r.text for r in got[13]] == ["a", "a"]
    assert html_consensus.extract(pages.limit(0)).count() == 0


def test_votes_outweigh_a_page_of_its_own_kind():
    odd = html_consensus.Page("<body><main><div class='x'>" + "word " * 50 + "</div><p>rest of it</p></main></body>")
    assert odd.paths[odd.best()] == "body>main>div.x"
    assert odd.text(["body>main"]).endswith("\nrest of it")


def test_no_text_of_an_article_is_left_behind(spark):
    body, links = "<div class='body'>" + "long text " * 80 + "</div>", "<ul>" + "<li><a href='/x'>some other page</a>" * 9 + "</ul>"
    lead = "<h1>Title</h1><p>The lead is told here</p>" + body
    split = "<div class='a'>" + "one half " * 30 + "</div>" + links + "<div class='b'>" + "other half " * 20 + "</div>"
    kinds = {
        "article": (f"<article>{lead}</article>{links}", "Title\nThe lead"),
        "wrapper": (f"{links}<div class='w'>{lead}</div>", "Title\nThe lead"),
        "parts": (f"{links}<div class='part1'>first piece of text</div><div class='part2'>second</div>", "first piece of text\nsecond"),
    }
    for name, (html, begin) in kinds.items():
        rows = [(i, f"http://{name}.org/{i}", f"<html><body><nav>menu</nav>{html}</body></html>") for i in range(4)]
        rows += [(9, f"http://{name}.org/9", f"<html><body><nav>menu</nav>{split}</body></html>")]
        got = {r.page_id: r.text for r in html_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[9].startswith("one half") and got[9].endswith("other half"), name
        if name != "parts":
            assert all(got[i].startswith(begin) and got[i].endswith("long text") for i in range(4)), name
        else:
            assert all(got[i].endswith(begin) for i in range(4))


def test_every_layout_of_a_host_has_its_votes(spark):
    links = "<ul>" + "<li><a href='/x'>some other page</a>" * 9 + "</ul>"
    rows = []
    for k in range(8):  # all pages but one of a layout have text beside the text, so that the wider container gets the votes
        inner = f"<div class='kind{'abcdefgh'[k]}'>{{}}<div class='in'>told here {'long text ' * 20}</div>{links}</div>"
        rows += [(100 * k + i, inner.format("<p>by an author</p>")) for i in range(20 - k)] + [(100 * k + 99, inner.format(""))]
    pages = spark.createDataFrame([(i, "http://h.org/x", f"<body><nav>menu</nav>{html}</body>") for i, html in rows],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_consensus.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[100 * k].startswith("by an author\ntold") and got[100 * k].endswith("page") for k in range(8))
    assert all(got[100 * k + 99].startswith("told here") and got[100 * k + 99].endswith("some other page") for k in range(8))


@pytest.mark.parametrize("name", [
    "class='content with-sidebar'", "class='no-sidebar'", "class='ad-free'", "class='has-header'", "id='search-page'", "class='search'"])
@pytest.mark.parametrize("tag", ["article", "p"])
def test_wrappers_are_not_left_out_for_a_word_in_their_class(name, tag):
    ad, story = "<div class='ad'>Buy this</div>", f"<{tag}>" + "the story " * 9 + f"</{tag}>"
    want = ("the story " * 9).strip()
    assert html_consensus.Page(f"<body><nav>menu</nav><div {name}>{ad}{story}</div>{ad}</body>").text([]) == want
    beside = f"<div id='comments'><article>{'a comment ' * 40}</article></div><div class='cookie-notice'>Accept</div>"
    assert html_consensus.Page(f"<body><article>{'the story ' * 9}</article>{ad}{beside}</body>").text([]) == want
    assert html_consensus.Page(f"<body><article></article>{ad}</body>").text([]) == ""
    halves = "<div class='search-left'>one half</div><div class='search-right'>and other</div>"
    assert html_consensus.Page(f"<body>{halves}</body>").text([]) == "one half\nand other"


# --- 10


def test_urls(spark):
    urls = ["http://a.net/x", "https://Sub.Example.NET/en/1?q=/de/", "http://example.net/EN/1", "http://shop.example.com/de/a",
            "http://example.com/de", "http://example.com", "http://x.org/fr/", "http://notexample.com/de/x", "http://u@b.net:80/", "nothing",
            "", None, "://", "http://a.net", "http://x.org/fr#/fr/", "ftp://a.b/c?d://e.net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))
    got = {r.page_id: r for r in url_templates.judge_urls(pages).collect()}
    assert url_templates.judge_urls(pages).count() == len(rows)
    assert [got[i].host for i in range(16)] == [
        "a.net", "sub.example.net", "example.net", "shop.example.com", "example.com", "example.com", "x.org", "notexample.com", "u@b.net:80",
        "", "", "", "", "a.net", "x.org", "a.b"]
    assert [got[i].path for i in range(8)] == ["/x", "/en/1", "/EN/1", "/de/a", "/de", "", "/fr/", "/de/x"]
    assert [got[i].rule for i in range(8)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, None, "org/fr/", None]
    assert [got[i].verdict for i in range(2)] == ["block", "allow"] and got[13].rule is None and got[14].path == "/fr"
    assert url_templates.judge_urls(pages.limit(0)).count() == 0


def test_templates_are_generalised_merged_and_rejected(spark):
    rules = (("h.org/bad", "block"), ("h.org/good", "allow"))
    rows = [f"http://h.org/bad{i % 3}/item/{i}" for i in range(90)] + [f"http://h.org/good/{w}" for w in vocabulary(3, 300)]
    rows += ["http://h.org/other/1"]
    got = url_templates.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    templates = {r.template: (r.verdict, round(r.purity, 2)) for r in got}
    assert templates == {"bad<n>/item/<n>": ("block", 0.98), "good/*": ("allow", 0.01), "other/<n>": ("allow", 0.5)}


# --- the pipeline


def test_stages_keep_columns_and_survive_odd_rows(docs, empty, spark, tmp_path):
    items = spark.createDataFrame([(1, corpus()[6][1]), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, empty):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= given.count()


def test_pipeline(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, corpus()[66][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in got.collect()}
    rows = [(r[0], r[1]) for r in corpus()]
    find = re.compile(r"[^\W_]+").findall
    item = shingles(rows[66][1].lower(), 5, find)
    unique = defaultdict(list)
    for d, t in rows:
        if any(c.isalpha() for c in t or ""):
            unique[re.sub(r"\s", "", t)].append((d is None, -len(t), d or 0, d, t))
    left = [(x[3], x[4]) for x in (min(v, key=lambda y: (y[1], y[0], y[2])) for v in unique.values())]
    parts = {d: c for d, _, c in brute_components(left, 5, 80) if d is not None}
    want = {c for d, t in left if d is not None and (c := parts[d]) == d
            and len(item & shingles(t.lower(), 5, find)) < 0.8 * len(item)}
    assert kept - {None} == want


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i,) for i in range(300)], "k long").repartition(3)
    facts = rows.groupBy("k").agg(F.count("*").alias("size"))
    assert common.lookup(rows, facts, "k", F.col("size"), 300_000).count() == 300
    assert common.lookup(rows, facts, "k", F.col("size"), 300).count() == 300


def test_word_split_is_that_of_the_contract():
    texts = ["a\u00a0b c\x1cd\te", None, "", "  x  ", "\x0b\x0c"]
    from packetloom.llm.words import split
    ids, words, count = split(pa.array(texts))
    assert [words[i] for i in ids] == [w for t in texts for w in WORD.findall(t or "")] and count.tolist() == [3, 0, 0, 1, 0]


def test_sql_of_the_quotes_says_the_same(spark):
    import duckdb

    from compare import table as cells
    rng, words = random.Random(8), vocabulary(21)
    lines, rows = [" ".join(rng.choices(words, k=6)) for _ in range(12)], []
    for c in range(12):
        for t in range(8):
            body = []
            for _ in range(rng.randint(0, 6)):
                depth = rng.choice([0, 0, 1, 1, 2])
                body.append(rng.choice(["", "> ", ">"] if depth else [""]) * depth + rng.choice([*lines, "", "On Monday X wrote:"]))
            rows.append((c, t, rng.choice(["user", None]), "\n".join(body)))
    names = ["conv_id", "turn", "role", "text"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(quote_links.SQL)
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns) and set(names) <= set(columns)
    assert cells(got.columns, [tuple(r) for r in got.collect()]) == cells(columns, cursor.fetchall())
