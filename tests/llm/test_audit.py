"""Source divergence, the conversation trie and near duplicates against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph import session
from weftgraph.llm import bpe, decontaminate, divergence, jaccard, langid, oddsketch, oracle, trie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def clashing(frame, *names):
    return frame.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def plain_divergence(rows, least, top):
    """rows (text, lang, source), by the definition, with every kept term of every group."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, own, groups = Counter(), Counter(), defaultdict(Counter)
        for terms, of, s in found:
            if of == lang:
                docs.update(set(terms))
                own.update(terms)
                groups[s].update(terms)
        kept = sorted(t for t, n in docs.items() if n >= least)

        def prices(count, kept=kept):
            n = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // n for t in kept}

        q, p = prices(own), {s: prices(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in groups if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(ranked)]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    r = random.Random(5)
    words = ["the", "The", "naïve", "Ünder", "b", "x-y", "日本", "z" * 3000, "É", "é"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["s0", "s1", "é", None, *(f"t{k}" for k in range(6))])) for _ in range(300)]
    rows += [("one two", "alone", "s"), ("", "alone", "t"), (None, "alone", "u")] + [("same same", "en", "s0")] * 40
    frame = clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), "term", "n", "idx", "rank", "value", "part")
    columns = ("lang", "source", "part", "item", "value", "rank")
    want = plain_divergence(rows, 5, 4)
    assert sorted(map(tuple, divergence.source_divergence(frame, 5, 4).select(*columns).collect())) == want
    # sources in several blocks, several slices, sums in many pieces, counts handed on early
    for name, value in (("SOURCES", 3), ("SLICE_ROWS", 10), ("AT_ONCE", 7), ("HELD", 4), ("SORTED", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.source_divergence(frame, 5, 4).select(*columns).collect())) == want
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_divergence_prices_are_exact_for_large_counts(spark):
    rows = [(10**13, 3 * 10**13 + 7, 10**8), (0, 10**18, 10**8), (7, 0, 1), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(divergence._p(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else 0 for n, t, v in rows]


@pytest.mark.parametrize("most_sorted", [0, 128])
def test_radix_top(spark, most_sorted):
    r = random.Random(3)
    rows = [(g, r.choice([5, 7, 7, 7, 1_000_000_001, 3, 1 << 20]), r.choice(["a", "bb", "é", "", "same prefix, and long "]) * r.randint(1, 9) + str(k)) for g in "xyz" for k in range(300)]
    rows += [("w", 1, "a")] * 2 + [("v", 9, "t")] * 200
    got = divergence.radix_top(spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", 50, most_sorted).collect()
    want = [(g, k + 1, v, t) for g in "vwxyz" for k, (_, v, t) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:50])]
    assert sorted((x.g, x["rank"], x.v, x.t) for x in got) == sorted(want)


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(v)) for c, v in turns.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        s = own.get(c - c % 20, ())[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def trie_rows(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.select(*names).collect())


@pytest.fixture(scope="module")
def talks():
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["hi", "hi there you", "", None, " two  words "])) for c in range(160) for t in range(r.randint(1, 6))]
    rows += [(c, t, "user", "the same talk") for c in range(1000, 1300) for t in range(3)]  # one large group of copies
    rows += [(500, t, "u", f"long {t}") for t in range(400)] + [(7, None, "user", "no number"), (7, 0, "user", "a tie"), (7, 0, "bot", "a tie"), (7, 0, "bot", "a tie"), (None, 1, "user", "x")]
    return rows + [(21, 0, "user", "of a block without its first"), (2_000_000_000_041, 0, "user", "far")]


def test_prefix_trie(spark, talks, monkeypatch):
    frame = clashing(spark.createDataFrame(talks, TURNS).repartition(3), "key", "words", "own", "base", "depth", "n", "kind")
    want = plain_trie(talks)
    assert trie_rows(trie.prefix_trie(frame)) == want
    # many partitions, stitched in rounds; children that are given out before their parent is done; ids in many runs
    monkeypatch.setattr(trie, "HELD", 2)
    monkeypatch.setattr(trie, "RUN", 5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert trie_rows(trie.prefix_trie(frame, fan=3)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert trie.prefix_trie(frame.limit(0)).count() == 0


def test_stitching_any_segments():
    """Sweeps over any cut of sorted arrays, stitched in any grouping, give one trie."""
    r = random.Random(2)
    for _ in range(60):
        rows = sorted((tuple(r.choices("ab", k=r.randint(0, 5))), c) for c in range(r.randint(1, 30)))

        def swept(cuts, rows=rows):
            nodes, stacks = [], []
            for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                sweep = trie.Sweep(hashed=True)
                for names, c in rows[a:b]:
                    sweep.row(c, [n.encode() for n in names], [1] * len(names))
                sweep.end(number)
                nodes += [x for x in sweep.out if x["kind"] == trie.NODE]
                stacks.append([x for x in sweep.out if x["kind"] == trie.STACK])
            while True:
                size, groups = r.randint(2, 4), []
                whole = len(stacks) <= size
                for at in range(0, len(stacks), size):
                    sweep = trie.Sweep(hashed=False)
                    for stack in stacks[at : at + size]:
                        sides = ([], [])
                        for x in stack:
                            node = trie.Node(x["depth"], x["turn"], x["words"], x["parent"], x["pid"], x["left"])
                            node.add(x["low"], x["n"], x["children"], x["leaves"], x["saved"])
                            sides[x["side"]].append(node)
                        sweep.segment(*sides, whole)
                    sweep.end(at, whole)
                    nodes += [x for x in sweep.out if x["kind"] == trie.NODE]
                    groups.append([x for x in sweep.out if x["kind"] == trie.STACK])
                if whole:
                    return sorted((x["pid"], x["depth"], x["low"], x["n"], x["children"], x["leaves"], x["saved"]) for x in nodes)
                stacks = groups

        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(r.randint(0, 9)))})
        assert swept(cuts) == swept([0, len(rows)])


@pytest.mark.parametrize("name", ["SOURCE_DIVERGENCE", "PREFIX_TRIE"])
def test_sql_says_the_same(name):
    """The registered SQL against the plain versions, which the operators are tested against."""
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in db.execute(getattr(oracle, name)).fetchall())
    if name == "PREFIX_TRIE":
        assert got == plain_trie(db.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    else:
        assert got == plain_divergence(db.execute("SELECT text, lang, source FROM documents").fetchall(), 30, 50)


def plain_near(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words))
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                head[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def copies():
    """Chains of small edits, whose ends aren't similar and whose leaders link to few; groups of copies; ties at the threshold."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for _ in range(4):
        text = r.choices(words, k=120)
        for _ in range(40):
            text = list(text)
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    base = r.choices(words, k=200)
    rows += [(1000 + k, " ".join([*base[:k], "X", *base[k + 1 :]])) for k in range(60)] + [(2000 + k, " ".join(base)) for k in range(50)]
    rows += [(3000, "a b c d e f"), (3001, "A b c d e"), (3002, "a b"), (3003, "one"), (3004, "One"), (3005, "ONE "), (3006, ""), (3007, None), (3008, " \n"), (3009, "É é"), (3010, "é é")]
    rows += [(None, "no id at all"), (None, "no id at all"), (3011, "no id at all "), (None, "by itself"), (3000, "a b c d e f"), (4000, "word " * 30000)]
    return rows


def test_near_duplicates(spark, copies):
    frame = clashing(spark.createDataFrame(copies, "doc_id long, text string").repartition(4), "set_id", "size", "key", "keys", "row", "id", "label", "leader")
    out = oddsketch.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept")
    got = Counter(map(tuple, out.collect()))
    want = plain_near(copies)
    assert {r[:3] for r in got} == {r[:3] for r in want} and sum(got.values()) == len(copies)
    assert got == Counter({r[:3] + (r[0] == r[2],): n for r, n in want.items()})
    assert oddsketch.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_in_blocks(spark, copies, monkeypatch):
    """Groups and blocks of few sets."""
    monkeypatch.setattr(oddsketch, "GROUP", 5)
    monkeypatch.setattr(oddsketch, "LED", 3)
    rows = [r for r in copies if r[0] is not None and r[0] < 1100]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_near(rows)


def near_copies(n: int) -> list[tuple[int, str]]:
    """A text with more or less of its words replaced: many copies of copies aren't linked with each other, and some with none."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    return [(i, " ".join(f"x{r.randrange(10**6)}" if r.random() < lost else w for w in base)) for i in range(n) for lost in [r.uniform(0.01, 0.08)]]


def test_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """Blocks of few sets: a large group of near copies isn't dealt to as many blocks as it has, in each of its buckets."""
    monkeypatch.setattr(oddsketch, "GROUP", 8)
    frame = type(spark.range(1))
    plain, made = frame.mapInArrow, []

    def counted(self, func, *args, **kwargs):
        if func.__name__ == "choose":
            made.append(self.count())
        return plain(self, func, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    rows = near_copies(400)
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(map(tuple, got)) == plain_near(rows)
    assert len({r[2] for r in got}) > 10
    assert len(made) == 1 and made[0] < 32 * len(rows), made


def test_odd_sketches_estimate_high_similarities():
    """What differs in more than CUT bits isn't similar, and sketches tell 0.8 from 0.5."""
    r = np.random.default_rng(4)
    for common, lost in ((0.8, 0), (0.9, 0), (0.5, 38)):
        over = 0
        for _ in range(40):
            union = r.integers(0, 1 << 63, size=1000, dtype=np.uint64) * np.uint64(2)
            both = int(1000 * common)
            a, b = union[: both + (1000 - both) // 2], np.concatenate([union[:both], union[both + (1000 - both) // 2 :]])
            x, y = (oddsketch.odd_sketch(oddsketch.samples(np.sort(s))).view(np.uint64) for s in (a, b))
            over += int(np.bitwise_count(x ^ y).sum()) > oddsketch.CUT
        assert over >= lost if lost else over == 0


def held_mb(run, texts) -> float:
    """MB that Python holds after run over each of the texts."""
    tracemalloc.start()
    try:
        for text in texts:
            run(text)
        return tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()


def many_words(n: int):
    """Texts of 1,000 words each, n words in all, none twice."""
    for at in range(0, n, 1000):
        yield " ".join("w" + str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(at, at + 1000))


def test_workers_of_the_pipeline_keep_few_words():
    """Caches of words stay small, whatever the number of words."""
    shingler = jaccard.Shingler()
    assert held_mb(shingler.tokens, many_words(300_000)) < 20
    seen = np.zeros((langid.GRAM_MOST + 1, 4))
    scorer = langid.Scorer(langid.Model(list("abcd"), [{} for _ in range(langid.GRAM_MOST + 1)], seen, np.array([0]), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)))
    assert held_mb(scorer.predict, many_words(300_000)) < 20


def test_small_caches_change_no_result(monkeypatch):
    texts = [*many_words(20_000), *many_words(3000), "one two", "", None]
    want = [jaccard.Shingler().tokens(t).tolist() for t in texts]
    monkeypatch.setattr(jaccard, "CACHE_WORDS", 1500)
    shingler = jaccard.Shingler()
    assert [shingler.tokens(t).tolist() for t in texts] == want
    assert len(shingler.known) <= 2501


def test_texts_are_held_by_runs(monkeypatch):
    """Decontamination holds the texts of one run of words, not those of a whole batch; no text is lost between runs."""
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 100)
    texts, taken = ["x" * (5 * n) for n in (40, 60, 1, 500, 0, 100, 99, 2)], []
    texts[4] = None
    runs = decontaminate._by_words(taken.append(t) or t for t in texts)
    first = next(runs)
    assert first == (0, texts[:2]) and len(taken) == 3
    rest = list(runs)
    assert [at for at, _ in rest] == [2, 3, 4, 6, 7] and sum((own for _, own in rest), first[1]) == texts
    assert list(decontaminate._by_words([])) == []


class Handed:
    """Stands for documents; mapInArrow gives back the function that it is handed."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_worker_keeps_no_chunks_after_token_ids():
    """The next stage's tasks run in the same worker, beside what this one kept."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    bpe.encoder.cache_clear()
    run = bpe.token_ids(Handed(), path, pattern)
    texts = [*many_words(3000), None, "one two"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    first, again = (pa.Table.from_batches(run(iter([batch]))).to_pylist() for _ in range(2))
    assert first == again and len(first) == len(texts) and all(r["intact"] for r in first) and first[3]["n_tokens"] == 0
    assert bpe.encoder(path, pattern).known == {}


def test_pipeline_hands_small_batches_to_workers(spark):
    """Batches are bounded by bytes, whatever the length of rows, and all rows arrive; a size that the session has set stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(1, "one two three", "en", "s", 13)], DOCS)
    long_rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("abcdefgh"), 1000).alias("text"))
    held = spark.conf.get(key, None)
    try:
        for stage in (corpus_pipeline.known_language, corpus_pipeline.near_duplicates, corpus_pipeline.benchmark_passages, corpus_pipeline.token_ids):
            spark.conf.unset(key)
            stage(spark, docs, SF)
            found = long_rows.mapInArrow(sizes, "rows long, size long").collect()
            assert sum(r.rows for r in found) == 3000 and max(r.size for r in found) < 1.5 * session.BATCH_BYTES
        spark.conf.set(key, "1m")
        session.in_small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)
