"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import bpe, decontaminate, jaccard, langid, lmscore, pii, quality, queries, secrets, sharding, tokenfile

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null, empty, blank, tie, repeated row, a long text, an odd script
EDGE = [
    (None, "no id here", "en", "s", 1), (1, None, "en", "s", 1), (2, "", None, "s", 1), (3, " \n\t ", "en", "s", 1), (4, "same words in a row", "en", "s", 1),
    (4, "same words in a row", "en", "s", 1), (5, "word " * 30000, "en", "s", 1), (6, "Привет мир ½ ²  naïve İstanbul", "xx", "s", 1), (7, "ﬁ don't 'sun a_b !!", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Also columns that are called as the operators call theirs."""
    clashing = ("row", "values", "own", "copies", "key", "place", "id", "mark", "hash", "lang_pred", "score")
    return spark.createDataFrame(EDGE, DOCS).select("*", *[F.lit(k).alias(name) for k, name in enumerate(clashing)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def base_spans(text):
    """The contract of the secret scan, by the re module."""
    text = text or ""
    rules = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [s for *_, s in sorted(found)]


def test_secrets(docs, edge, none):
    rng = random.Random(4)
    odd = ["token='", "é", "PASSWORD: ", "api_key=", "AKIA", "abcdef0123456789", "=x", " ", "Z9" * 9, "passwd", "--", "s"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for t in texts:
        named = [f"{secrets.RULES[k].kind}:{a}:{e}" for a, k, e in secrets.scan(t)]
        assert [x for x in named if x.split(":")[0] in ("assign", "access", "hex")] == base_spans(t), t
    for frame in (docs, edge):
        text = defaultdict(list)
        for r in frame.collect():
            text[r.doc_id].append(hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest())
        got = defaultdict(list)
        for r in secrets.find_secrets(frame).collect():
            got[r.doc_id].append(r.base_sha256)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in text.items()}
    assert secrets.find_secrets(none).count() == 0
    for t in ("0123456789abcdef" * 40_000, "AKIA" * 5_000 + " " + "eyJ" * 5_000, "token=" * 2_000 + "x" * 20, "gh" + "p_" * 3_000, "deadbeef" * 3 + "AKIA" + "0" * 20 + "secret:abcdefabcdefabcdefabcdef"):
        named = [f"{secrets.RULES[k].kind}:{a}:{e}" for a, k, e in secrets.scan(t)]
        assert [x for x in named if x.split(":")[0] in ("assign", "access", "hex")] == base_spans(t)


def base_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, edge, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weight = quality.weights(docs, quality.trusted_ids(labels))
    for frame in (docs, edge):
        expected = sorted((r.doc_id or -1, *base_quality(r.text)) for r in frame.collect())
        got = quality.score_documents(frame, weight).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    # the score from its definition, by Spark's own hash of each word and pair
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    pairs = sorted({(a, b) for w in words.values() for a, b in zip(w, [*w[1:], ""], strict=False)} | {("", "")})
    hashed = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("a", "b").alias("y")).collect()
    of_word, of_pair = {r.a: r.x % quality.BUCKETS for r in hashed}, {(r.a, r.b): r.y % quality.BUCKETS for r in hashed}
    found = {i: [of_word[a] for a in w] + [of_pair[p] for p in zip(w, [*w[1:], ""], strict=False)] for i, w in words.items()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    raw, target = Counter(b for f in found.values() for b in f), Counter(b for i, f in found.items() if i in trusted for b in f)
    n_raw, n_target = (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS for c in (raw, target))
    ratio = lambda b: math.log((target[b] + quality.SMOOTHING) / n_target * n_raw / (raw[b] + quality.SMOOTHING))
    for r in quality.quality(docs, labels).collect():
        score = sum(map(ratio, found[r.doc_id])) / max(1, len(found[r.doc_id]))
        assert math.isclose(r.score, score, abs_tol=5e-6)
        assert r.kept == (not r.base_failed and score >= quality.LEAST_SCORE) or abs(score - quality.LEAST_SCORE) < 1e-5
    assert quality.quality(none, labels).count() == 0 and set(quality.weights(docs, labels.select("doc_id").limit(0))) == {0.0}


def test_decontamination(spark, edge, none):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 4, size=rng.integers(1, 9)).tolist(), rng.integers(0, 4, size=rng.integers(0, 14)).tolist()
        line = [0] * (len(b) + 1)
        for i in range(len(a)):
            new = [i + 1]
            for j in range(len(b)):
                new.append(min(line[j + 1] + 1, new[j] + 1, line[j] + (a[i] != b[j])))
            line = new
        assert decontaminate.run_distance(a, b) == min(line)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, words = decontaminate.Index(items), [f"w{k}" for k in range(400)]
    found = 0
    for _ in range(200):
        i, text = items[rng.integers(len(items))]
        own = decontaminate.words_of(text)
        for _ in range(decontaminate.edits_allowed(len(own))):
            k, p = rng.integers(3), rng.integers(len(own))
            own[p : p + (k != 1)] = [] if k == 2 else [words[rng.integers(400)]]
        found += i in {index.ids[m] for _, m, _ in index.matches([" ".join(words[:50] + own + words[50:90])])}
    assert found >= 0.95 * 200
    bench = spark.createDataFrame([*items[:5], (99, None), (98, "too short")], "item_id long, text string")
    planted = spark.createDataFrame([(1, f"before {items[0][1].upper()} after"), (2, "clean text " * 20), (3, " ".join(items[1][1].split()[:6])), (None, items[2][1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(planted, bench).collect()} == {(1, items[0][0], 0), (None, items[2][0], 0)}
    assert [r.doc_id for r in decontaminate.decontaminated(planted, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.contaminated(edge, bench).count() == 0 and decontaminate.decontaminated(edge, bench).count() == len(EDGE)
    assert decontaminate.contaminated(planted, bench.limit(0)).count() == 0 and decontaminate.decontaminated(none, bench).count() == 0


def edited(rng, words, edits):
    """words after so many random replacements, insertions and deletions."""
    own = list(words)
    for _ in range(edits):
        k, p = rng.integers(3), rng.integers(len(own))
        own[p : p + (k != 1)] = [] if k == 2 else [f"w{rng.integers(400)}"]
    return own


def test_decontamination_at_the_ends_of_texts(spark):
    """What is found doesn't depend on the texts beside: an item that is a whole text, begins or closes one, among other texts."""
    rng = np.random.default_rng(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, other, alone, texts = decontaminate.Index(items), " ".join(f"w{k}" for k in range(60)), set(), []
    for n in range(240):
        words = decontaminate.words_of(items[rng.integers(len(items))][1])
        own = " ".join(edited(rng, words, decontaminate.edits_allowed(len(words))))
        texts += [(own, f"{other} {own}", f"{own} {other}")[n % 3], other]
        alone |= {(2 * n, item, distance) for _, item, distance in index.matches([texts[-2]])}
    assert len(alone) >= 0.9 * 240 and set(index.matches(texts)) == alone


@pytest.mark.parametrize("many", [200, 10_400])
def test_decontamination_recall_by_length(many):
    """At the largest distance, also of long items and with more than 10,000 of them."""
    rng = np.random.default_rng(7)
    lengths = rng.permutation(np.resize([10, 20, 50, 63, 100, 150, 255, 511], many)).tolist()
    items = [(k, " ".join(f"v{w}" for w in rng.integers(20_000, size=n))) for k, n in enumerate(lengths)]
    index, found = decontaminate.Index(items), defaultdict(list)
    for k in range(120):
        words = items[k][1].split()
        text = [f"w{j}" for j in range(30)] + edited(rng, words, decontaminate.edits_allowed(len(words))) + [f"w{j}" for j in range(30, 60)]
        found[len(words)].append(k in {index.ids[m] for _, m, _ in index.matches([" ".join(text)])})
    assert all(sum(x) >= len(x) - 2 for x in found.values()) and sum(map(sum, found.values())) >= 0.975 * 120, {n: sum(x) / len(x) for n, x in found.items()}
    assert all(len(c.walks) >= 8 for c in index.classes)


def test_decontamination_walks_only_where_an_item_may_begin(spark, monkeypatch):
    """Hardly any place of texts in the benchmark's words but not its order; every place within the edits of one where a run at the largest distance begins, or ends."""
    rng, plain, walked = np.random.default_rng(9), decontaminate.walk, []
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    monkeypatch.setattr(decontaminate, "walk", lambda line, starts, *rest: walked.append((line, starts)) or plain(line, starts, *rest))
    pool = [w for _, text in items for w in decontaminate.words_of(text)]
    assert not list(index.matches([" ".join(rng.permutation(pool)) for _ in range(4)]))
    assert sum(len(starts) for _, starts in walked) < 0.02 * 4 * len(pool) * sum(len(c.walks) for c in index.classes)
    for words in (decontaminate.words_of(text) for _, text in items):
        k = decontaminate.edits_allowed(len(words))
        walked.clear()
        list(index.matches([" ".join([f"w{j}" for j in range(30)] + edited(rng, words, k) + [f"w{j}" for j in range(60)])]))
        for backwards, at in enumerate((31, 61)):
            assert any(set(range(at - k, at + k + 1)) <= set(starts.tolist()) for line, starts in walked if (np.argmax(line > decontaminate.UNKNOWN) > 45) == backwards)


def plain_contaminated(docs, items, least_words):
    """By definition, each text with each item."""
    split = [(i, decontaminate.words_of(t)) for i, t in items]
    out = Counter()
    for doc_id, text in docs:
        words = decontaminate.words_of(text)
        for i, item in split:
            if len(item) >= least_words and (d := decontaminate.run_distance(item, words)) <= decontaminate.edits_allowed(len(item)):
                out[doc_id, i, d] += 1
    return out


def test_decontamination_of_short_items_and_scripts_without_blanks(spark):
    """Short items are found exactly, whatever their edits; characters are the words of Chinese, Japanese and Thai."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))) for k in range(60)] + [(90, "東京は日本の首都です。人口が多い"), (91, "กรุงเทพมหานคร"), (92, "中文")]
    texts = [(k, " ".join(rng.choice("abcdx") for _ in range(rng.randint(0, 12)))) for k in range(150)] + [(200, "昔、東京は日本の首都でした。人口が多い"), (201, "x กรุงเทพมหานคร y"), (202, "我学中文"), (203, None)]
    for least in (1, decontaminate.LEAST_WORDS):
        index = decontaminate.Index(items, least_words=least)
        got = Counter((texts[n][0], index.ids[m], d) for n, m, d in index.matches([t for _, t in texts]))
        assert got == plain_contaminated(texts, items, least) and any(d for _, _, d in got)
    assert got[200, 90, 2] and got[201, 91, 0] and not got[202, 92, 0]


def test_decontamination_query_against_brute_force(spark):
    """Each document of the smallest tables with each item, by definition."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_contaminated(docs, items, decontaminate.LEAST_WORDS)
    assert Counter((r.doc_id, r.item_id, r.distance) for r in queries.op3_decontamination(spark, SF).collect()) == want and len(want) > 0


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_differencing_is_balanced(shards):
    sizes = np.random.default_rng(shards).integers(1, 1000, size=400).tolist()
    load = Counter()
    for size, shard in zip(sizes, sharding.differencing(sizes, shards), strict=True):
        load[shard] += size
    assert max(load.values()) - min(load[k] for k in range(shards)) <= 2 * shards and sum(load.values()) == sum(sizes)


def test_sharding(docs, edge, none):
    for frame in (docs, edge):
        rows, text = sharding.shard_documents(frame).collect(), frame.collect()
        assert len(rows) == len(text)
        want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in text)
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
        slots, where = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            where[r.text_crc32, r.size].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_is_balanced_over_the_whole_table(spark):
    rows = queries.op4_sharding(spark, "/root/testdata/sf0.1").collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    largest = max(Counter(r.text_crc32 for r in rows).values())
    assert set(load) == set(range(sharding.SHARDS)) and {r.law for r in rows} == {"bytes"} and largest > 1
    assert max(load.values()) - min(load.values()) <= 16


def test_token_files(spark, docs, edge, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenfile._tokenizer(path)
    odd = [(k, t, "en", "s", 1) for k, t in enumerate(["a <|endoftext|> b", "x<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>Hello<|endoftext|>", "<|STARTOFTEXT|> <|x", "A<|b|>C don't<|"])]
    odd += [(None, "<|endoftext|>", "en", "s", 1), (None, None, "en", "s", 1), (None, "one more", "en", "s", 1), (2, "Again", "en", "s", 1)]
    for n, frame in enumerate((docs, edge, spark.createDataFrame(odd, DOCS))):
        folder = f"file://{tmp_path}/{n}"
        manifest = tokenfile.write_ids(frame, folder, path)
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_ids(manifest).collect()), key=lambda r: r[1])
        start, want = 0, []
        hashed = frame.withColumn("h", F.xxhash64("text")).collect()
        for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
            ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
        fs, at = pafs.FileSystem.from_uri(manifest.orderBy(F.col("part").desc()).first().path)
        reader = tokenfile.Reader(fs.open_input_file(at))
        some = int(reader.doc_ids[-1])
        assert reader.named[-1] and reader.document(some)[-1] == 2
        with pytest.raises(KeyError):
            reader.document(some + 1)
    raw = bytearray(open(at, "rb").read())
    raw[12] ^= 1
    import pyarrow as pa

    with pytest.raises(Exception):  # noqa: B017
        tokenfile.Reader(pa.BufferReader(bytes(raw))).frame(0)
    assert tokenfile.encode_to_files(none, path).count() == 0


KEY = "a key of the tests"


def luhn_holds(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark, edge, none):
    cards = [c for c in (f"4{k:014d}{d}" for k in range(0, 4000, 37) for d in range(10)) if luhn_holds(c)]
    rows = [(k, f"a {c} b") for k, c in enumerate(cards)]
    out = [r.text.split()[1] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert all(map(luhn_holds, out)) and len(set(out)) == len(cards) and not set(out) & set(cards)
    text = "joe.34@mail7.example.com, joe.34@mail7.example.com +1 (017) 555-7713 97.51.17.173 123-45-6789 1999-12-31 31.12.1999 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32"
    kept = "v2.0.0 999.1.1.1 000-12-3456 2020-02-30 4111111111111112 12345"
    got = pii.pseudonymise(spark.createDataFrame([(1, text), (2, text + " again"), (3, kept)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert got[1].text == got[0].text + " again" and got[2].text == kept
    words = got[0].text.split()
    assert words[0].rstrip(",") == words[1] and re.fullmatch(r"[a-z]{3}\.\d\d@mail7\.example\.com", words[1]) and "joe" not in got[0].text
    assert not (set(text.split()[2:]) - {"+1"}) & set(words) and len(got[0].text.split()) == len(text.split())
    assert [got[0][f"n_{k}"] for k in pii.KINDS] == [2, 1, 1, 2, 1, 1, 1]
    year, month, day = words[7].split("-")
    assert words[8] == f"{day}.{month}.{year}"
    same = pii.pseudonymise(edge, KEY, counts=False)
    assert same.columns == edge.columns and sorted(map(str, same.collect())) == sorted(map(str, edge.collect()))
    assert pii.pseudonymise(none, KEY).count() == 0


def test_pseudonyms_link_phones_in_any_layout(spark):
    same = [
        ["+49 30 1234567", "+49301234567", "+49 (30) 123-4567", "+49-30-1234567", "+49 (0)30 1234567", "+49.30.123.4567"], ["+1 212 555 0147", "+12125550147", "(212) 555-0147", "212-555-0147", "+1 (212) 555-0147"],
        ["+33 1 23 45 67 89", "+33123456789"], ["+351 21 123 4567", "+351211234567"], ["+7 495 123-45-67", "+74951234567"],
    ]
    rows = [(k, f"call {x} now") for k, x in enumerate(x for group in same for x in group)]
    got = iter([r.text[5:-4] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY, counts=False).orderBy("doc_id").collect()])
    for group in same:
        new = [next(got) for _ in group]
        assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) and a != b for a, b in zip(group, new, strict=True))
        code = re.match(r"\+(49|1|33|351|7)", group[0])[0]
        national = {re.sub(r"\D", "", x.replace(code, "", 1).replace("(0)", "") if x.startswith("+") else x) for x in new}
        assert all(x.startswith(code) for x in new if x[0] == "+") and len(national) == 1


def test_pseudonym_key_is_in_no_plan(spark, docs):
    key = "not to be seen anywhere"
    frame = pii.pseudonymise(docs, key)
    assert key not in frame._jdf.queryExecution().toString() and key not in frame._jdf.queryExecution().explainString(frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert queries.pseudonym_key(spark) == queries.pseudonym_key(spark) and len(queries.pseudonym_key(spark)) >= 32


def test_pseudonyms_beside_other_numbers(spark):
    """(text, the value that goes, what follows and stays)"""
    cases = [
        ("+33 1 23 45 67 89", "", "phone"), ("+33 1 23 45 67 89", " 1999-12-31", "phone"), ("+49.30.123456", "", "phone"), ("+49 30 1234567", " x", "phone"), ("+4930123456", ".", "phone"),
        ("+33 1 23 45 67 89", " 4111 1111 1111 1111", "phone"), ("+33 1 23 45 67 89", " 123-45-6789", "phone"), ("+49 30 123456", " 9.8.7.65", "phone"),
        ("4111 1111 1111 1111", " 123", "card"), ("4111-1111-1111-1111", "-12", "card"), ("4111 1111 1111 1111", " 123-45-6789", "card"), ("4111 1111 1111 1111", " 7 x", "card"),
        ("BE68 5390 0754 7034", " EUR", "iban"), ("BE68539007547034", " 4111 1111 1111 1111", "iban"), ("GB82 WEST 1234 5698 7654 32", " EUR", "iban"),
    ]
    rows = pii.pseudonymise(spark.createDataFrame([(k, f"to {a}{b}") for k, (a, b, _) in enumerate(cases)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    for (value, after, kind), r in zip(cases, rows, strict=True):
        new, rest = r.text[3 : 3 + len(value)], r.text[3 + len(value) :]
        assert r[f"n_{kind}"] >= 1 and new != value and re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", new)) == re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", value)), (value, r)
        assert sum(a != b for a, b in zip(new, value, strict=True)) >= 4 and new[-4:] != value[-4:], (value, r)
        assert (rest == after) == (not re.search(r"\d{4}|(\d+\.){3}", after)), (after, r)
        assert "4111" not in after or luhn_holds(re.sub(r"\D", "", rest))
        assert kind != "card" or luhn_holds(re.sub(r"\D", "", new))


def plain_number(key, tag, *parts):
    return int(hashlib.sha256("|".join((key, tag, *map(str, parts))).encode()).hexdigest()[:12], 16)


def plain_pair(key, tag, x, y, sizes):
    for k in range(1, pii.ROUNDS + 1):
        size = sizes[0] if k % 2 else sizes[1]
        x, y = y, (x + plain_number(key, tag, k, y)) % size
    return x, y


def plain_text(key, tag, text):
    x, y = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, pii.ROUNDS + 1):
        other, new = hashlib.sha256(y.encode()).hexdigest(), ""
        for at, c in enumerate(x):
            first, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            new += chr((ord(c) - first + plain_number(key, tag, k, at, other)) % size + first) if size else c
        x, y = y, new
    return x + y


def plain_day(key, day, fits):
    day -= datetime.date(1700, 1, 1).toordinal()
    while True:
        low = day % pii.DAYS
        x, y = plain_pair(key, "date", low // pii.DAY_PARTS[1], low % pii.DAY_PARTS[1], pii.DAY_PARTS)
        day = day - low + x * pii.DAY_PARTS[1] + y
        if fits(datetime.date.fromordinal(day + datetime.date(1700, 1, 1).toordinal())):
            return datetime.date.fromordinal(day + datetime.date(1700, 1, 1).toordinal())


def test_pseudonyms_against_a_plain_feistel(spark):
    """The permutation by hashlib, on each kind's own parts."""
    x, y = plain_pair(KEY, "ip", 97 * 256 + 51, 17 * 256 + 173, (65536, 65536))
    a, b = plain_pair(KEY, "ssn", 122, 44 * 9999 + 6788, pii.SSN_PARTS)
    body = plain_text(KEY, "card", "411111111111111")
    check = next(d for d in range(10) if luhn_holds(f"{body}{d}"))
    day = plain_day(KEY, datetime.date(1999, 12, 31).toordinal(), lambda d: True)
    short = plain_day(KEY, datetime.date(2000, 2, 1).toordinal(), lambda d: d.month < 10 and d.day < 10)
    late = plain_day(KEY, datetime.date(2000, 2, 28).toordinal(), lambda d: d.day > 12)
    want = {
        "Joe.34-x@mail7.example.com": plain_text(KEY, "email", "Joe.34-x") + "@mail7.example.com",
        "97.51.17.173": f"{x // 256}.{x % 256}.{y // 256}.{y % 256}",
        "123-45-6789": f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}",
        "4111 1111 1111 1111": re.sub(r"(.{4})(?=.)", r"\1 ", f"{body}{check}"),
        "1999-12-31": day.isoformat(), "31.12.1999": day.strftime("%d.%m.%Y"), "2/1/2000": f"{short.month}/{short.day}/{short.year}", "28/02/2000": late.strftime("%d/%m/%Y"),
        "+1 (017) 555-7713": re.sub("#", "{}", "+1 (###) ###-####").format(*plain_text(KEY, "phone", "0175557713")),
    }
    frame = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(frame, KEY).orderBy("doc_id").collect()]
    assert dict(zip(want, got, strict=True)) == want


def test_pseudonyms_of_dates_keep_layout_and_never_meet(spark):
    layouts = ("{y}-{m:02d}-{d:02d}", "{d:02d}/{m:02d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}.{m}.{y}", "{m}/{d}/{y}", "{y}/{m}/{d}", "{m:02d}-{d:02d}-{y}")
    texts = sorted({f.format(y=y, m=m, d=d) for f in layouts for y in (1650, 1999, 2100, 9999) for m in (1, 9, 10, 12) for d in (1, 9, 10, 12, 13, 28)})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(frame, KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) and sum(a == b for a, b in zip(texts, got, strict=True)) <= 2
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(texts, got, strict=True))


def test_pseudonyms_in_long_texts(spark):
    """The worst shape for each pattern, half a megabyte each."""
    worst = ["a@" + "b." * 250_000 + "com", "1" * 500_000, "+1" * 250_000, "1-" * 250_000, "AB12 " * 100_000, "4111 " * 100_000, "a.b@" * 125_000, "1.2." * 125_000, "(1) " * 125_000, "x" * 2000 + "@y.org"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(worst)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [len(r.text) for r in rows] == [len(w) for w in worst]
    assert [r.doc_id for r in rows if r.text != worst[r.doc_id]] == [0, 9] and [r.n_email for r in rows] == [1, *[0] * 8, 1]


def brute_links(frame):
    shingler, sets = jaccard.Shingler(), {}
    for r in frame.collect():
        sets[r.doc_id] = set(shingler.tokens(r.text).tolist())
    where, links = defaultdict(list), defaultdict(set)
    for k, s in sets.items():
        for t in s:
            where[t].append(k)
    for k, s in sets.items():
        for z, n in Counter(z for t in s for z in where[t]).items():
            if z != k and n >= 0.8 * (len(s) + len(sets[z]) - n) - 1e-6:
                links[k].add(z)
    label = {k: k for k in sets}
    for _ in range(len(sets)):
        new = {k: min([label[k], *(label[z] for z in links[k])]) for k in sets}
        if new == label:
            break
        label = new
    return {k: (label[k], len(links[k])) for k in sets}


def near_copies(n=150):
    """One text and copies with a few words changed, more than one block and bucket hold; and texts that share a passage only."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(200)], []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = word()
        rows.append((k, " ".join(own)))
    shared = [word() for _ in range(60)]
    rows += [(n + k, " ".join([*shared, *(word() for _ in range(200))])) for k in range(120)]
    return rows


def test_jaccard_join(spark, docs, edge, none, monkeypatch):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute_links(docs)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    frame = spark.createDataFrame(near_copies(), "doc_id long, text string")
    want, got = brute_links(frame), {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_documents(frame).collect()}
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values()) and {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    kept = jaccard.first_of_each_class(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 1
    assert jaccard.similar_documents(none).count() == 0


def plain_lm_scores(rows, trusted):
    """Both models from their definition: doc_id -> words, losses under the target and the background model, for each row."""
    vocabulary = {w for _, t in rows for w in (t or "").lower().split()}
    outcomes = len(vocabulary) + 1

    def pairs(text):
        words = (text or "").lower().split()
        return list(zip(["<s>", *words], [*words, "</s>"], strict=True)) if words else []

    def model(texts):
        pair = Counter(p for t in texts for p in pairs(t))
        first = Counter()
        for (v, _), n in pair.items():
            first[v] += n
        loss = lambda v, w: round(lmscore.UNITS * (math.log(first[v] + lmscore.MASS) - math.log(pair[v, w] + lmscore.MASS / outcomes))) / lmscore.UNITS
        for v in ["<s>", *list(vocabulary)[:3]]:
            assert math.isclose(sum(math.exp(-(math.log(first[v] + lmscore.MASS) - math.log(pair[v, w] + lmscore.MASS / outcomes))) for w in [*vocabulary, "</s>"]), 1)
        return lambda text: sum(loss(*p) for p in pairs(text)) / max(1, len(pairs(text)))

    target, background = model([t for i, t in rows if i in trusted]), model([t for _, t in rows])
    return Counter((i, len((t or "").split()), round(target(t), 4), round(background(t), 4)) for i, t in rows)


def rounded(scored):
    rows = scored.collect()
    assert all(math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=2e-6) for r in rows)
    return Counter((r.doc_id, r.n_tokens, round(r.target_loss, 4), round(r.background_loss, 4)) for r in rows)


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_trusted_marks(spark, edge, monkeypatch, bits):
    """Exact whatever passes the filter, and for ids that are null, negative or repeated."""
    monkeypatch.setattr(quality, "FILTER_BITS", bits)
    ids = [-5, 0, 3, 4, 1 << 40]
    rows = edge.select("doc_id", "text").union(spark.createDataFrame([(i, "x") for i in (*ids, *range(100, 200))], "doc_id long, text string"))
    trusted = spark.createDataFrame([(i,) for i in (*ids, 150, 7_000)], "doc_id long")
    got = Counter((r.doc_id, r.text, r.mark) for r in quality.marked(rows, trusted).collect())
    assert got == Counter((r.doc_id, r.text, int(r.doc_id in (*ids, 150))) for r in rows.collect())
    assert quality.marked(rows, trusted.limit(0)).where("mark = 1").count() == 0


def same_losses(a, b):
    a, b = (sorted(x.elements(), key=lambda r: (str(r[0]), *r[1:])) for x in (a, b))
    return len(a) == len(b) and all(x[:2] == y[:2] and np.allclose(x[2:], y[2:], atol=2e-4) for x, y in zip(a, b, strict=True))


def test_lm_scores(spark, docs, edge, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    for frame in (docs, edge):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        assert same_losses(rounded(lmscore.cross_entropy_difference(frame, labels)), plain_lm_scores(rows, trusted))
    assert lmscore.cross_entropy_difference(none, labels).count() == 0
    few = spark.createDataFrame([(1, "a b a b c"), (2, "a b c"), (3, "x y z x"), (4, None), (3, "x y z x")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text) for r in few.collect()]
    assert same_losses(rounded(lmscore.cross_entropy_difference(few, marks)), plain_lm_scores(rows, {1}))
    assert same_losses(rounded(lmscore.cross_entropy_difference(few, marks.limit(0))), plain_lm_scores(rows, set()))


def test_lm_scores_do_not_depend_on_batches_and_buckets(spark, docs, monkeypatch):
    """Small batches, more buckets than the survey has cells, and buckets split by second words."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.limit(120).union(spark.createDataFrame([(-5, "the " * 3000, "en", "s", 1)], DOCS))
    found = lmscore.survey(rows)
    want = rounded(lmscore.score(rows, trusted, found))
    assert found.outcomes == len({w for r in rows.collect() for w in r.text.lower().split()}) + 1
    assert int(found.tokens.sum()) == sum(n + 1 for _, n, *_ in want.elements() if n)
    monkeypatch.setattr(lmscore, "BATCH_TOKENS", 500)
    for least, tokens, hot in ((4, 1 << 40, 0.5), (512, 1, 0.1)):
        monkeypatch.setattr(lmscore, "BUCKETS", least)
        monkeypatch.setattr(lmscore, "BUCKET_TOKENS", tokens)
        monkeypatch.setattr(lmscore, "HOT", hot)
        assert lmscore.bucket_parts(found.tokens).max() > 1
        assert rounded(lmscore.score(rows, trusted, found)) == want
    monkeypatch.setattr(quality, "FILTER_BITS", 64)  # nearly every document passes the filter
    assert rounded(lmscore.score(rows, trusted, found)) == want
    many = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(many).count() == 50_000


def plain_language(model, text):
    """Word-first backoff by its definition."""
    sums, n_words = np.zeros(len(model.langs)), 0
    for word in langid.words_of(text):
        n_words += 1
        if word in model.rows[0]:
            sums += model.logs_of(word, 0)
            continue
        for n in range(langid.GRAM_MOST, 0, -1):
            if found := [model.logs_of(g, n) for g in langid.grams_of(word, n) if g in model.rows[n] and (n == 1 or len(word) + 2 >= n)]:
                sums += np.mean(found, axis=0)
                break
    if not n_words:
        return langid.UNKNOWN, 0.0
    share = np.exp((sums - sums.max()) / n_words**0.5)
    return model.langs[int(sums.argmax())], share.max() / share.sum()


def test_language_id(spark, edge, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(docs.doc_id)))
    lang = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    rows = langid.predict(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and lang[r.doc_id][1] >= 40]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in test) >= 0.97 * len(test)
    few = docs.where("doc_id < 60 or length(text) < 40")
    for r in few.collect():
        lang_pred, score = plain_language(model, r.text)
        assert (lang_pred, round(score, 4)) == next((x.lang_pred, round(x.score, 4)) for x in rows if x.doc_id == r.doc_id)
    scorer, sparse = langid.Scorer(model), langid.Scorer(model)
    sparse.dense = None
    for r in few.collect():
        assert scorer.predict(r.text)[0] == sparse.predict(r.text)[0] and math.isclose(scorer.predict(r.text)[1], sparse.predict(r.text)[1])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(edge, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] != "und"
    assert langid.predict(none, langid.learn(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.learn(none)).collect()} == {"und"}


def test_byte_bpe(docs, edge, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in (docs, edge):
        want = Counter()
        for r in frame.collect():
            ids = plain.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(frame, path, public_tokenizers.PATTERN).collect()) == want
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for text in ["x" * 3000, "a b\n\n  c\t\r\n", "   ", "".join(rng.choice("aé漢 \n'!9") for _ in range(3000))]:
        assert own.encode([text])[0].tolist() == plain.encode_ordinary(text)
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def plain_pipeline(docs, items, model):
    """The five stages one after the other, each by its definition: doc_id -> token ids."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = [(i, t) for i, t in docs if (found := plain_language(model, t))[0] != langid.UNKNOWN and found[1] >= langid.LEAST_SCORE]
    shingler = jaccard.Shingler()
    sets = {i: set(shingler.tokens(t).tolist()) for i, t in known}
    label = {i: i for i in sets}

    def head(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for k in ids[n + 1 :]:
            both = len(sets[i] & sets[k])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[k]) - both) - 1e-6:
                x, y = sorted((head(i), head(k)))
                label[y] = x
    first = [(i, t) for i, t in known if head(i) == i]
    dirty = {i for i, *_ in plain_contaminated(first, items, decontaminate.LEAST_WORDS)}
    return [(i, t) for i, t in first if i not in dirty], plain


def test_pipeline(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "pii", "token_ids"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, plain = plain_pipeline(rows, items, langid.learn(docs.where(~langid.held_out(docs.doc_id))))
    masked = pii.pseudonymise(spark.createDataFrame(kept, "doc_id long, text string"), queries.pseudonym_key(spark), counts=False)
    want = {r.doc_id: plain.encode_ordinary(r.text) for r in masked.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) < len(rows) and all(r.intact and r.n_tokens == len(r.ids) for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, SF).columns == edge.columns


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
