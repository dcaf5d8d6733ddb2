"""The ten operators and the pipeline against SQL, brute force, round trips and held-out labels, with odd rows."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sliceloom.llm import components, decontaminate, exact, extract, lm, mixing, neardup, quality, registry, substrings, tokens, warc
from tests.test_queries import SF, duck, same  # noqa: F401

SCHEMA = "doc_id long, text string, source string, id long, n long, key string, html string"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
COPY = "Some shared passage that is much longer than fifty bytes, as it must be to count at all here."
TEXTS = [(1, COPY), (2, "x " + COPY + " y"), (3, None), (4, ""), (5, " \t\n"), (6, COPY), (None, COPY), (7, LONG), (8, LONG + " end"), (9, "é" * 80), (10, "z" + "é" * 80), (6, COPY), (11, "two words"), (12, "Two  words"), (6, "another text of the same id")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, ["b", None, "a"][i % 3], 1, 2, "k", "h") for i, (d, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):  # noqa: F811
    same(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name])


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(odd, none):
    got = mixing.mixed(odd)
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, _ in TEXTS)
    by = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.sum("size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= 1 and r.g <= 2 * r.s for r in by) and sum(r.s for r in by) == sum(sizes(t) for _, t in TEXTS)
    assert all(r.taken <= 2 * r.size for r in got.collect())
    mix = mixing.fair_mix(mixing.queued(mixing.sized(odd)))
    assert mix.agg(F.sum("served")).first()[0] == got.agg(F.sum("taken")).first()[0]
    order = [r.finish for r in mix.collect()]
    assert order == sorted(order) and order[-1] <= 1
    assert mixing.mixed(none).count() == 0


def test_exact(odd, none):
    got = rows(exact.exact_dedup(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    text = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in TEXTS]
    want = []
    for d, t in text:
        ids = [x for x, y in text if y == t]
        least = min((x for x in ids if x is not None), default=None)
        want.append((d, least, len(ids), d == least, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert rows(exact.exact_dedup(odd, support=0.5), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == got
    assert exact.exact_dedup(none).count() == 0


def covered(texts, width=50):
    first = {}
    for d, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - width + 1) if d is not None else ():
            first[b[i : i + width]] = min(d, first.get(b[i : i + width], d))
    out = []
    for d, t in texts:
        b, m = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - width + 1) if d is not None else ():
            if first[b[i : i + width]] < d:
                m[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substrings(spark, odd, none):
    assert rows(substrings.repeated_spans(odd), *COLUMNS) == covered(TEXTS)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(substrings.repeated_spans(docs), *COLUMNS) == covered([(r.doc_id, r.text) for r in docs.collect()])
    assert substrings.repeated_spans(none).count() == 0


def test_substrings_hot(spark):
    """A passage in more documents than an anchor may have is dealt by its strings."""
    texts = [(i, f"{i:05d} lead {COPY} tail {i * 7919:06d}") for i in range(400)]
    assert rows(substrings.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)), *COLUMNS) == covered(texts)


def test_suffix_levels():
    """Numbers of earlier equal suffixes, order within levels and doubling sizes, on texts that repeat each other."""
    rng = np.random.default_rng(1)
    pool = [bytes(rng.integers(97, 99, 8, np.uint8)) * int(rng.integers(5, 12)) + bytes(rng.integers(97, 123, int(rng.integers(0, 40)), np.uint8)) for _ in range(60)]
    raw = np.frombuffer(b"".join(pool[i] for i in rng.integers(0, 60, 900)), np.uint8)
    index, seen = substrings.SuffixLevels(raw), {}
    starts = np.arange(len(raw) - 49)
    key = lambda at: raw[at : at + 50].tobytes()
    for part in np.array_split(starts, 37):
        found, head = index.add(part, part + 7)
        before = dict(seen)
        for i, at in enumerate(part.tolist()):
            k = key(at)
            assert (found[i] >= 0) == (k in before) and (found[i] < 0 or before[k] == found[i]) and key(part[head[i]]) == k and head[i] <= i
            seen.setdefault(k, at + 7)
    for heads, at, rows_ in index.levels:
        keys = [key(x) for x in at.tolist()]
        assert keys == sorted(set(keys)) and (np.diff(heads.astype(object)) >= 0).all() and (rows_ == at + 7).all()
    sizes_ = [len(level[0]) for level in index.levels]
    assert sizes_ == sorted(sizes_, reverse=True) and len(sizes_) < 10 and sum(sizes_) == len(seen)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(texts, k, percent=80):
    sets = [(d, shingles(t, k)) for d, t in texts]
    parent = {d: d for d, s in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(live):
        for b, y in live[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted(((d, len(s), d if d is None or not s else root(d), d is None or not s or root(d) == d) for d, s in sets), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near(spark, odd, none, k):
    names = ("doc_id", "n_shingles", "component_id", "kept")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(neardup.near_duplicates(docs, k), *names) == linked([(r.doc_id, r.text) for r in docs.collect()], k)
    assert rows(neardup.near_duplicates(odd, k), *names) == linked(TEXTS, k)
    # one document of two texts links what each of them is like
    more = [(20, "a b c d e f g h"), (20, "q r s t u v w x"), (21, "A b c d e f g h"), (22, "q r s t u v w x"), (20, "a b c d e f g h")]
    assert rows(neardup.near_duplicates(spark.createDataFrame(more, "doc_id long, text string"), k), *names) == linked(more, k)
    assert neardup.near_duplicates(none, k).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        b = np.append(a[: int(400 * share)], rng.integers(0, 1 << 63, 400 - int(400 * share)).astype(np.uint64))
        s = neardup.sketches(np.append(a, b), np.array([0, 400, 800]))
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        errors.append(abs((s[0] == s[1]).mean() - share / (2 - share)))
    assert max(errors) < 0.2


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = registry.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.8
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = quality.fit(docs, labels)
    out = quality.scored(odd, model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.scored(none, model).count() == 0 and quality.fit(none, labels).score(np.zeros(1))[0] == 0.5


def test_component_rounds(spark, monkeypatch):
    """Against union-find; and each star's plan stands alone, as tasks of nested ones made up half of the driver's."""
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(int(u), int(v)) for u, v in rng.integers(200, 400, (150, 2))] + [(7, 7), (3, 0), (0, 3)]
    leader = {i: i for e in edges for i in e if e[0] != e[1]}

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for u, v in edges:
        if u != v and top(u) != top(v):
            leader[max(top(u), top(v))] = min(top(u), top(v))
    written, plans = components.materialize, []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")))
        return written(df, name)

    monkeypatch.setattr(components, "materialize", noted)
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["id"], r["component"]) for r in found) == sorted((i, top(i)) for i in leader)
    assert max(n for name, n in plans if "stars" in name) <= 4
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tokens(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    plain = Tokenizer.from_file(path)
    strange = ["a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "it's I'LL x''s don\n't", "J̌x. é.Ab-12٣3⃣ A1b22 ..a,,B €.x", "\x1c\x85 a\x1fb", "é ́e 한국 각 ΑΣ\tΣ ß İ ﷺ 🙂🙂 12 345x", None, ""]
    ids, n = tokens.WordEncoder(path).encode(pa.array(strange, pa.string()), 2)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in strange]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        at, expected = 0, []
        for d, t in texts:
            own = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            expected.append((d, at, len(own), zlib.crc32(own.tobytes())))
            at += len(own)
        assert rows(tokens.tokenized(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert tokens.tokenized(none, path).count() == 0


def test_new_words_go_together():
    """Many new words make few texts for the tokenizer, and any mix of characters has the ids of the whole text; also without marks of words' ends."""
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, of):
            self.of, self.texts = of, 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.of.encode_batch_fast(texts, **more)

    path = tokens.vocabulary_path()
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(5)
    encoder = tokens.WordEncoder(path)
    encoder.tokenizer = Counted(encoder.tokenizer)
    parts = ["a", "B", "é", "É", "'", "<", "<|endoftext|>", " ", "\n", "1", "2", "٣", ".", "|", "'s", "한", "\u0301", "\x1f", "\x85", "İ", "ß", "Z"]
    mixed = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 30, 500)]
    many = " ".join("".join(x) for x in rng.choice(list("abcdefghijK"), (5000, 9)))
    encoder.encode(pa.array([many], pa.string()), 2)
    assert encoder.tokenizer.texts <= 50
    for marked in (True, False):
        encoder.known, encoder.last = {}, encoder.last & marked
        ids, n = encoder.encode(pa.array([many, *mixed], pa.string()), 2)
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in (many, *mixed)]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_codes():
    ids = np.random.default_rng(5).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    codes = tokens.Codes.from_bytes(memoryview(tokens.Codes.encode(ids).to_bytes()))
    assert np.array_equal(codes.all(), ids) and all(codes[i] == ids[i] for i in range(0, 5000, 7)) and codes[4999] == ids[4999]
    with pytest.raises(IndexError):
        codes[5000]
    assert tokens.Codes.encode(ids[:0]).n == 0


def test_leaks(spark, odd, none):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    words = lambda t: (t or "").lower().split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    items = [(r.item_id, grams(words(r.text))) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for g in [grams(words(r.text))] for i, s in items if s and len(s & g) >= 0.8 * len(s)}
    assert whole and whole <= got
    some = spark.createDataFrame([(1, COPY, 0), (2, None, 0), (3, "", 0), (None, COPY, 0)], "item_id long, text string, doc_id long")
    assert {r.doc_id for r in decontaminate.leaks(odd, some).collect()} == {1, 2, 6, None}
    assert decontaminate.leaks(none, some).count() == 0 and decontaminate.leaks(odd, some.where("false")).count() == 0


def test_leaks_long_and_apart(spark):
    long = " ".join(f"item{i}" for i in range(400))
    question, answer = " ".join(f"ask{i}" for i in range(20)) + "?", " ".join(f"say{i}" for i in range(20)) + "."
    gap = " ".join(f"other{i}" for i in range(500))
    docs = [(i, f"{' '.join(gap.split()[:i * 16])} {long} {gap}") for i in range(4)] + [(9, f"{gap} {answer} {gap} {question} {gap}"), (10, gap)]
    bench = spark.createDataFrame([(1, long), (2, f"{question} {answer}")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (9, 2)}
    # items of 300, 600 and 1,000 words; equal items are both reported, so are equal rows
    items = [(n, " ".join(f"p{n}q{i}" for i in range(n))) for n in (300, 600, 1000)]
    docs = [(n, f"{gap} {t} {gap}", "x") for n, t in items] + [(600, f"{gap} {items[1][1]} {gap}", "x")]
    bench = spark.createDataFrame([*items, (7, items[0][1])], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), bench).collect())
    assert got == {(300, 300): 1, (300, 7): 1, (600, 600): 2, (1000, 1000): 1}


def test_leaks_short_parts(spark):
    question = "Which of the many rivers of the old province is by far the longest?"
    docs = [(1, f"{question} We asked, and it is the Blue Nile. they said"), (2, f"{question} it is said: nile. The Blue"), (3, "the Blue Nile. once more"), (4, "two words"), (5, "here are two words of many more in a longer text"), (6, "words two"), (7, "x")]
    bench = spark.createDataFrame([(1, f"{question} The Blue Nile."), (2, "two words"), (3, "What is that then? No.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, 0.9).collect()}
    assert set(got) == {(1, 1), (4, 2), (5, 2)} and got[1, 1].answer_overlap == 1 and got[1, 1].overlap < 0.9


def test_retrieval_equals_exhaustive_scoring():
    """Block-max pruning finds all pairs that scoring every item finds, and no other."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(3000)])
    text = lambda n: " ".join(words[np.minimum(rng.zipf(1.3, n) - 1, 2999)])
    items = [text(int(rng.integers(1, 60))) for _ in range(1300)]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    index.MOST = 5000  # work is split
    docs = [text(40) for _ in range(40)] + [text(30) + " " + items[i] for i in range(0, 1300, 50)]
    h, off, _, _ = decontaminate._hashed(docs, 5)
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    term = np.where(index.terms[at] == h, at, -1)
    got = set(zip(*(x.tolist() for x in index.retrieve(term, np.repeat(np.arange(len(docs)), np.diff(off)))[:2]), strict=True))
    sets = [Counter(t.split()) for t in items]
    df = Counter(w for s in sets for w in s)
    mean = np.mean([sum(s.values()) for s in sets])

    def impact(w, s):
        return np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * s[w] * 2.2 / (s[w] + 1.2 * (0.25 + 0.75 * sum(s.values()) / mean))

    want = {(d, i) for d, t in enumerate(docs) for own in [set(t.split())] for i, s in enumerate(sets) if sum(impact(w, s) for w in s.keys() & own) >= 0.5 * sum(impact(w, s) for w in s) - 1e-9}
    assert got == want and len(want) > 20


def test_template_classes():
    """Classes of any occurrence vector that nest; pages of another layout do not void them."""
    page = "<html><body><div>Site</div><ul>{}</ul><section><h2>Story {}</h2><p>text {}</p><small>All rights</small></section><div>Foot</div></body></html>"
    pages = [page.format("".join(f"<li>{i * 7 + j}</li>" for j in range(i % 3 + 2)), i, i * i) for i in range(12)]
    tokens = [extract._tokens(p) for p in [*pages, "", "<p>other</p>"]]
    fixed, slots = extract.template(tokens)
    assert {t for _, t in fixed} == {"Site", "All rights", "Foot"}
    story = [s for t, s in zip(tokens[3], slots[3], strict=True) if t.text == "Story 3"]
    assert story != [None] and {s for own, line in zip(tokens[:12], slots, strict=False) for t, s in zip(own, line, strict=True) if (t.text or "").startswith("Story")} == set(story)
    assert extract.main_texts([*pages, "", "<p>other</p>"])[-2:] == ["", "other"]
    # an order that differs from page to page is no class
    odd = [f"<div>a</div><p>x{i}</p><div>b</div>" if i % 2 else f"<div>b</div><p>x{i}</p><div>a</div>" for i in range(8)]
    assert not {"a", "b"} & {t for _, t in extract.template([extract._tokens(p) for p in odd])[0]}
    kept = "<article><header><h1>Title {0}</h1></header><div class='related-work'><p>body {0}</p></div><p>x{0}</p><div class='related-posts'>no</div><div class='post-comments'>no</div></article>"
    assert extract.main_texts([kept.format(i) for i in range(3)])[1] == "Title 1 body 1 x1"


def test_extract(spark):
    page = "<html><head><title>t</title><style>a{}</style></head><body><header>Site</header><nav><a>Home</a></nav><article><h1>Head {0}</h1><p>Body &amp;  text<b>bold</b> {0}</p><div class='comments'><p>bad</p></div></article><aside>ad</aside><script>x<y</script><footer>foot</footer></body></html>"
    pages = [(i, f"http://h.example/{i}", page.replace("{0}", str(i)), 0) for i in range(8)] + [(100, None, None, 0), (101, "odd", "", 0), (102, "http://z/", "plain &lt;text", 0), (None, "http://z/", "plain", 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in extract.extracted(frame).collect()}
    assert all(got[i].text == f"Head {i} Body & textbold {i}" and got[i].n_chars == len(got[i].text) for i in range(8))
    assert got[100].text == got[101].text == "" and got[102].text == "plain <text" and got[None].text == "plain"
    assert extract.extracted(frame.where("false")).count() == 0
    # four distinct pages of a host are too few for a template, five are enough; repeated rows stay, pages may be long
    plain = "<body><p>Common line</p><p>own {0}</p></body>"
    for n, want in ((4, "Common line own 0"), (5, "own 0")):
        rows_ = [(i, "http://few.example/", plain.replace("{0}", str(i))) for i in range(n)] * 2
        assert [r.text for r in extract.extracted(spark.createDataFrame(rows_, "page_id long, url string, html string")).where("page_id = 0").collect()] == [want] * 2
    long = extract.extracted(spark.createDataFrame([(1, "http://l/", "<p>" + "word " * 300_000 + "</p>")], "page_id long, url string, html string")).first()
    assert long.n_chars == 5 * 300_000 - 1


@pytest.mark.parametrize("compressed", [True, False])
def test_warc(spark, compressed):
    inner = warc.record(77, "http://inner/", b"fake", None)
    html = ["<p>a</p>", "<p>a</p>", None, "", "x" + inner.decode() + inner.decode(), "é" * 3000, "<p>a</p>", "big " * 400_000]
    pages = spark.createDataFrame([(i if i != 6 else None, f"http://h/ \n{i}", h, 0) for i, h in enumerate(html)], "page_id long, url string, html string, at long")
    got = warc.read_archives(warc.write_archives(pages, compressed)).collect()
    by = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}
    assert len(got) == len(html)
    files = {r.file for r in got}
    archives = [gzip.open(f.removeprefix("file://")).read() if compressed else open(f.removeprefix("file://"), "rb").read() for f in files]
    names = re.findall(rb"WARC-Record-ID: <urn:uuid:([^>]*)>", b"".join(archives))
    assert len(set(names) - {re.search(rb"uuid:([^>]*)>", inner)[1]}) == len(html)  # also where page_ids are null
    for i, h in enumerate(html):
        raw = (h or "").encode()
        to = {0: 1, 2: 3, 6: 1}.get(i)
        assert by[i if i != 6 else None] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to)
    assert warc.archived(pages.where("false")).count() == 0


def test_warc_ties(spark):
    """Rows that tie for the largest page_id are all responses, also where rows repeat."""
    rows_ = [(1, "u", "a"), (2, "u", "a"), (2, "v", "a"), (2, "v", "a"), (3, "w", "b"), (3, "w", "c"), (None, "n", "d"), (None, "n", "d")]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect())
    assert got == {(1, "revisit", 2): 1, (2, "response", None): 3, (3, "response", None): 2, (None, "response", None): 2}


def test_reachable():
    at, to = np.array([0, 5, 10, 12, 20, 30]), np.array([10, 12, 20, 30, 40, 41])
    assert warc.reachable(at, to).tolist() == [True, False, True, False, True, False]
    n = 1000
    assert warc.reachable(np.arange(n), np.arange(1, n + 1)).all() and not len(warc.reachable(at[:0], to[:0]))


def test_lm(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.fit(docs)
    table = np.exp(model[1].reshape(-1, lm.CLASSES)).sum(axis=1)
    assert np.allclose(table, 1, atol=1e-3)
    texts = [(r.doc_id, r.text) for r in docs.where("text is not null").limit(30).collect()]
    rng = np.random.default_rng(0)
    mixed = [(d, " ".join(rng.permutation(t.split()))) for d, t in texts]
    mean = lambda x: lm.scored(spark.createDataFrame(x, "doc_id long, text string"), model).agg(F.avg("mean_logprob")).first()[0]
    assert mean(texts) > mean(mixed)
    got = {(r.doc_id, r.n_words): r for r in lm.scored(odd, model).collect()}
    assert got[3, 0].logprob == 0 and got[3, 0].mean_logprob is None and (7, 30_000) in got
    assert lm.scored(none, lm.fit(none)).count() == 0


def test_lm_predicts_words(spark):
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(400)]
    texts = [(d, " ".join(rng.choice(names, 60))) for d in range(40)]
    docs = spark.createDataFrame([*texts, (40, texts[0][1]), (41, None)], "doc_id long, text string")
    model = lm.fit(docs)
    kind, logp, counts, _, known, _ = model
    code = lambda w: int(lm._hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    of = lambda w: int(kind[code(w) % lm.SLOTS])
    # words of one class, made up ones included, are no longer worth the same
    rare = next(w for w in names if of(w) <= lm.REST)
    alike = next(f"gibberish{i}" for i in range(10_000) if of(f"gibberish{i}") == of(rare))
    score = {r.doc_id: r.logprob for r in lm.scored(spark.createDataFrame([(1, rare), (2, alike)], "doc_id long, text string"), model).collect()}
    assert score[1] > score[2]
    # every word by hand
    seen, cells = Counter(), Counter()
    for _, t in [*texts, (40, texts[0][1])]:
        w = t.split()
        side = [0, *map(of, w), 0]
        for i, x in enumerate(w):
            seen[x] += 1
            cells[x, side[i], side[i + 2]] += 1
    total = counts.reshape(-1, lm.CLASSES)
    want = 0
    w = texts[3][1].split()
    side = [0, *map(of, w), 0]
    for i, x in enumerate(w):
        ctx = side[i] * lm.CLASSES + side[i + 2]
        prior = seen[x] / (total[:, of(x)].sum() + 1)
        want += logp[ctx * lm.CLASSES + of(x)] + np.log((cells[x, side[i], side[i + 2]] + lm.PRIOR * prior) / (total[ctx, of(x)] + lm.PRIOR))
    got = {r.doc_id: r.logprob for r in lm.scored(docs, model).collect()}
    assert len(got) == 42 and abs(got[3] - want) < 1e-6 and got[0] == pytest.approx(got[40], abs=1e-9)
    # what is gathered is every (word, left, right) of the corpus
    assert sum(len(r.contexts) // 2 for r in known.collect()) == len(cells)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF).cache()
        if name == "near_duplicates":
            want = {r[0] for r in linked([(r.doc_id, r.text) for r in before.collect()], 5) if r[3]}
            assert {r.doc_id for r in kept.collect()} == want
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - bad
        if name != "tokens":
            assert kept.columns == docs.columns and kept.count()
    assert rows(corpus_pipeline.run(spark, SF), *kept.columns) == rows(kept, *kept.columns)


def test_pipeline_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeated ids and columns of clashing names pass every stage; so does nothing."""
    wide = odd.withColumns({c: F.lit(1) for c in ("row", "times", "copy", "start", "served", "_chosen", "_copy", "item_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        if name == "tokens":
            assert out.count() == len(TEXTS)
        else:
            assert out.columns == wide.columns
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert kept <= set(TEXTS) and (name in ("quality", "mixing") or {(None, COPY), (11, "two words")} <= kept)
            assert name != "mixing" or all((t or "").split() for _, t in kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.where("false"), SF).count() == 0
