"""The operators against brute force, exact round trips and held-out labels."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import capfilter, decontam, langmix, lattice, licences, linedup, queries, simhash, siteprior, toxicpu, warcseg

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def components(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(0, 5), max_size=40))
def test_common_words(a, b):
    n, used = decontam.common_words(np.array(a), np.array(b, int))
    assert n == lcs(a, b) == used.sum()
    it = iter(b)
    assert all(x in it for x in np.array(a)[used].tolist())


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in", "a", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("bcdfgaeiou", k=6))
    items = [[word() for _ in range(rng.randint(15, 50))] for _ in range(20)]
    docs, want = [], set()
    for d in range(120):
        text = [word() for _ in range(rng.randint(10, 400))]
        if d % 3 == 0:
            k = rng.randrange(20)
            part = list(items[k])
            if d % 2:  # a paraphrase: some words replaced, some dropped
                part = [w if rng.random() > 0.15 else word() for w in part if rng.random() > 0.08]
            at = rng.randrange(len(text))
            text[at:at] = part
            if lcs(items[k], part) >= 0.7 * len(items[k]):
                want.add((d, k))
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {d for d, _ in got} <= set(range(0, 120, 3))


def test_every_pair_of_a_table_by_alignment_alone(spark):
    """No retrieval at all: each item against the surroundings of each block and each two blocks of each document."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    own = decontam.items(bench)
    encoded = decontam.encode(docs, own).cache()
    w, _ = decontam.weights(encoded, own, 0.04)
    want = set()
    for r in encoded.collect():
        code = np.frombuffer(r.codes, own.kind).astype(np.int64)
        for k, item in enumerate(own.codes):
            inside = np.r_[0, np.cumsum(np.isin(code, item))]
            for at in range(0, len(code), decontam.BLOCK):
                for width in (1, 2):
                    lo, hi = max(0, at - len(item)), min(len(code), at + width * decontam.BLOCK + len(item))
                    n, used = decontam.common_words(item, code[lo:hi]) if inside[hi] - inside[lo] >= 0.6 * len(item) else (0, None)
                    share, heavy = n / len(item), w[item - 1] > 0
                    if share >= 0.8 or (share >= 0.6 and used[own.answers[k] :].mean() >= 0.5 and used[heavy].sum() >= 0.5 * heavy.sum()):
                        want.add((r.doc_id, own.ids[k]))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == want and len(want) > 10


@pytest.mark.parametrize("lost", [0, 1, 3, 4])
def test_a_copy_that_lost_its_rare_words(spark, lost):
    """40 words of which 4 are rare; the copy has all the common ones and the rare ones but `lost`."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(60)]
    item = rng.sample(common, 36)
    for i, at in enumerate((3, 14, 25, 36)):
        item.insert(at, f"rare{i}")
    gone = {f"rare{i}" for i in range(lost)}
    say = lambda: rng.choices(common, k=200)
    docs = [(d, " ".join(say())) for d in range(300)] + [(1000, " ".join([*say()[:70], *(x for x in item if x not in gone), *say()[:70]]))]
    bench = [(1, " ".join(item)), *((k, " ".join(rng.choices(common, k=30) + [f"o{k}"] * 5)) for k in range(2, 20))]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).filter("doc_id = 1000 and item_id = 1").collect()
    assert [(r.kind, round(r.lcs, 3)) for r in got] == [("copy", (40 - lost) / 40)]


def test_sums_of_long_runs():
    rng = np.random.default_rng(0)
    size = np.array([0, 1, 300, 0, 64, 65, 5000, 2])
    table, pick, x = rng.standard_normal((50, 4)), rng.integers(0, 50, size.sum()), rng.standard_normal(size.sum())
    ends = np.cumsum(size)
    assert np.allclose(decontam._sums(table, pick, x, size), [(table[pick[e - n : e]] * x[e - n : e, None]).sum(0) for n, e in zip(size, ends, strict=True)])


def test_latent_space_is_the_leading_one(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = decontam.items(bench)
    encoded = decontam.encode(documents, own).cache()
    w, n = decontam.weights(encoded, own, 0.04)
    gram = decontam._gram(encoded, own, w, np.eye(len(w)))
    a = []
    for r in encoded.collect():
        code = np.frombuffer(r.codes, own.kind).astype(np.int64)
        for at in range(0, len(code), decontam.BLOCK):
            x = np.bincount(code[at : at + decontam.BLOCK], minlength=len(w) + 1)[1:] * w
            a.append(x / max(np.linalg.norm(x), 1e-12))
    assert np.allclose(gram, np.array(a).T @ np.array(a), atol=1e-3)
    size, word, x = decontam.weighted_items(own, w)
    rows = np.zeros((len(size), len(w)))
    rows[np.repeat(np.arange(len(size)), size), word] = x
    full = gram + max(1.0, 0.1 * n / len(size)) * rows.T @ rows
    q = decontam.latent(encoded, own, w, n, 64)
    assert np.allclose(q.T @ q, np.eye(64), atol=1e-6)
    best = np.linalg.eigvalsh(full)[::-1][:64].sum()
    assert np.trace(q.T @ full @ q) > 0.75 * best  # a flat spectrum, of which 64 random directions would have a sixteenth


def test_hash_lookup():
    known = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    known[:3] = [0, 1, 2]
    look = lattice.T.Lookup(known)
    assert (look.find(known) == np.arange(len(known))).all() and (look.find(known + np.uint64(1))[3:] == -1).all()
    assert lattice.T.Lookup(known[:0]).find(known[:9]).tolist() == [-1] * 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=9), min_size=1, max_size=40), st.integers(0, 3))
def test_span_hashes_do_not_depend_on_place(parts, gap):
    data = (b"-" * gap).join(parts)
    size = np.array([len(x) for x in parts])
    start = np.cumsum(size + gap) - size - gap
    h = lattice.T.span_hash(np.frombuffer(data, np.uint8), start, start + size)
    assert all((a == b) == (x == y) for a, x in zip(h, parts, strict=True) for b, y in zip(h, parts, strict=True))


def test_languages(spark, documents):
    p = langmix.fit(documents)
    rows = langmix.detect(documents, p).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.top_language == r.lang for r in rows if r.n_words > 5]) > 0.97
    assert np.mean([r.kept for r in rows if r.n_words > 5]) > 0.97
    by = defaultdict(list)
    for r in documents.filter("n_chars > 2000").select("lang", "text").collect():
        by[r.lang].append(r.text[:1500])
    a, b = by["en"][0], by["es"][0]
    odd = spark.createDataFrame([(1, a + "\n" + b), (2, "xqzj kvwq zzxq qqkj wvxz " * 20)], "doc_id long, text string")
    mixed, junk = langmix.detect(odd, p).orderBy("doc_id").collect()
    assert set(mixed.languages) == {"en", "es"} and abs(sum(mixed.shares) - 1) < 1e-3
    assert not junk.kept


def test_languages_of_documents_it_did_not_see(documents):
    p = langmix.fit(documents.filter("doc_id % 2 = 0"))
    rows = langmix.detect(documents.filter("doc_id % 2 = 1"), p).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.top_language == r.lang for r in rows if r.n_words > 5]) > 0.97
    assert np.mean([r.kept for r in rows if r.n_words > 5]) > 0.97


def test_language_sets_against_all_sets(documents):
    """Short mixtures: the penalised likelihood of the set that is chosen against the best of all 31 sets, each by many rounds."""
    p = langmix.fit(documents)
    rng = random.Random(4)
    by = defaultdict(list)
    for r in documents.filter("n_chars > 500").select("lang", "text").collect():
        by[r.lang] += re.findall(r"[^\W\d_]+", r.text)[:400]
    gaps, same = [], 0
    for _ in range(60):
        words = [w for lang in rng.sample(sorted(by), rng.choice([1, 1, 2, 3])) for w in rng.sample(by[lang], rng.randint(8, 40))]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        share, n = langmix.infer(raw, np.array([0, len(raw)]), p, 1.0, 12)
        h, ok = langmix.trigrams(raw, np.array([0, len(raw)]))
        start, _ = lattice.T.spans(raw, np.array([0, len(raw)]))
        ll = np.add.reduceat(p.logp[h] * ok[:, None], start)
        lik = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))

        def score(chosen, lik=lik):
            x = lik[:, list(chosen)]
            w = np.full(len(chosen), 1 / len(chosen))
            for _ in range(300):
                post = x * w
                w = (post / post.sum(1, keepdims=True)).mean(0)
            return np.log(x @ w).sum() - 0.5 * len(chosen) * np.log(len(lik) + 1)

        sets = {c: score(c) for k in range(1, 6) for c in itertools.combinations(range(5), k)}
        got = tuple(np.flatnonzero(share[0] > 0).tolist())
        best = max(sets, key=sets.get)
        assert n[0] == len(lik)
        same += got == best
        gaps.append(sets[best] - sets[got])
    assert same >= 54 and max(gaps) < 3


def test_site_posteriors_in_plain_python(spark):
    rng = random.Random(6)
    rows = [(i, h, f"{h}/{rng.randint(0, 2)}", rng.gauss(0, 2)) for i in range(300) for h in [f"h{rng.choice([0, 0, 0, 1, 2, 3])}"]]
    known = {i: float(rng.random() < 0.7) for i in range(0, 300, 4)}
    n, y = len(known), sum(known.values())
    rate = (y + 1) / (n + 2)
    p = {i: known.get(i, 1 / (1 + np.exp(-(e + np.log(rate / (1 - rate)))))) for i, _, _, e in rows}
    base = (sum(p.values()) + 1) / (len(rows) + 2)

    def concentration(groups):  # of (number, sum, mean above it)
        g = [x for x in groups if x[0] > 1]
        rho = (sum(n * (s / n - m) ** 2 for n, s, m in g) - sum(m * (1 - m) for _, _, m in g)) / sum((n - 1) * m * (1 - m) for n, _, m in g)
        return 1 / min(max(rho, 1e-4), 0.9) - 1

    def sums(column):
        out = defaultdict(lambda: [0, 0.0])
        for r in rows:
            out[r[column]][0] += 1
            out[r[column]][1] += p[r[0]]
        return out

    hosts, paths = sums(1), sums(2)
    kh = concentration([(n, s, base) for n, s in hosts.values()])
    mean = {h: (s + kh * base) / (n + kh) for h, (n, s) in hosts.items()}
    kp = concentration([(n, s, mean[x.split("/")[0]]) for x, (n, s) in paths.items()])
    got = {r.doc_id: r for r in siteprior.posterior(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"), spark.createDataFrame([(i, v) for i, v in known.items()], "doc_id long, quality double")).collect()}
    for i, h, x, e in rows:
        hm = (hosts[h][1] - p[i] + kh * base) / (hosts[h][0] - 1 + kh)
        pm = (paths[x][1] - p[i] + kp * hm) / (paths[x][0] - 1 + kp)
        q = 1 / (1 + np.exp(-(e + np.log(pm / (1 - pm)))))
        assert np.allclose([got[i].host_mean, got[i].path_mean, got[i].quality], [hm, pm, q], atol=1e-9) and got[i].kept == (q >= 0.5)


def test_quality_on_labels_it_did_not_see(documents, labels):
    even, odd = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = siteprior.classify(documents, even).join(odd, "doc_id").select("kept", odd["quality"]).collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "", "en", f"h{min(i % 50, 3)}") for i in range(400)] + [(1000, "", "en", "tiny")], "doc_id long, text string, lang string, source string")
    known = [(i, int(i % 50 != 0), 0) for i in range(400)]
    rows = {r.host: r.path_mean for r in siteprior.classify(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    assert rows["h0"] < rows["tiny"] < rows["h1"]


def test_toxicity_on_labels(documents, labels):
    half = labels.filter("doc_id % 2 = 0")
    model = toxicpu.fit(documents, half, min_support=2)
    rows = toxicpu.detect(documents, model).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    caught = [r.said for r in rows if r.toxic == 1]
    assert np.mean([r.said for r in rows if r.toxic == 0]) < 0.02
    assert np.mean(caught) > 0.5


def test_toxicity_with_the_parameters_of_the_query(spark):
    """Fitted to the labels of every other document of a larger table, tried on the others. Two thirds of the toxic ones hold one of ten insults, the others rare words of other languages."""
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicpu.fit(docs, known.filter("doc_id % 2 = 0"))
    rows = toxicpu.detect(docs, model).withColumnRenamed("toxic", "said").join(known.filter("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    insults = {"pathetic", "stupid", "moron", "disgusting", "scum", "worthless", "trash", "idiot", "loser", "clown"}
    assert np.mean([r.said for r in rows if r.toxic == 1 and insults & set(re.findall(r"\w+", r.text.lower()))]) > 0.97
    assert np.mean([r.said for r in rows if r.toxic == 1]) > 0.7
    assert np.mean([r.said for r in rows if r.toxic == 0]) < 0.01


def test_shares_of_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(5)] + [(5, " ".join([*words, "more"])), (6, "quite another text"), (7, ""), (8, None)]
    h = np.unique(lattice.T.hash_words("another w3 absent"))
    got = {r.doc_id: (r.share, [int(h[k]) for k in r.held]) for r in toxicpu.weighted(spark.createDataFrame(rows, "doc_id long, text string"), h).collect()}
    own = lambda x: [int(v) for v in lattice.T.hash_words(x)]
    assert set(got) == set(range(7)) and got[6] == (1.0, own("another")) and got[0][1] == own("w3")
    assert {got[i][0] for i in range(5)} <= {1 / 5, 1 / 6} and got[5][0] in (1 / 6, 1.0)


@pytest.fixture(scope="module")
def insulted(spark):
    """3,000 documents, 300 of them with two of ten insults, and the labels of every third; further ones by copies and heat."""
    rng = random.Random(8)
    said = lambda: rng.choices([f"w{k}" for k in range(400)], k=40)
    rude = lambda: " ".join(said() + [f"bad{k}" for k in rng.sample(range(10), 2)])
    rows = [(i, rude() if i % 10 == 0 else " ".join(said())) for i in range(3000)]
    more = {
        "copies": [(10_000 + i, " ".join(["bad1 bad2 bad3 bad4 bad5", *(f"w{k}" for k in range(80)), f"n{i}"])) for i in range(900)],
        "hot": [(20_000 + i, rude()) for i in range(1000)],
        "plain": [],
    }
    known = [(i, int(i % 10 == 0)) for i in range(0, 3000, 3)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string").cache()
    return {k: frame(rows + x) for k, x in more.items()}, spark.createDataFrame(known, "doc_id long, toxic int")


@pytest.mark.parametrize("corpus, only_positives", [("copies", False), ("hot", False), ("plain", True), ("hot", True)])
def test_toxicity_does_not_hang_on_how_many_others_are_toxic(insulted, corpus, only_positives):
    tables, known = insulted
    model = toxicpu.fit(tables[corpus], known.filter("toxic = 1") if only_positives else known)
    rows = toxicpu.detect(tables[corpus], model).collect()
    toxic = lambda i: i >= 10_000 or i % 10 == 0
    assert np.mean([r.toxic for r in rows if toxic(r.doc_id)]) > 0.97
    assert np.mean([r.toxic for r in rows if not toxic(r.doc_id)]) < 0.01


def test_risk_starts_despite_rounding():
    x = np.c_[np.arange(100) < 10, np.ones(100)].astype(float)
    sp = x[:10].T @ x[:10] / 10
    sp[-1, -1] += 1e-15
    assert toxicpu.train(sp, x.T @ x / 100, 0.1)[0] > 1


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    x = np.c_[rng.random((500, 6)) < 0.3, np.ones(500)].astype(float)
    y = x[:, 0] > 0
    w = toxicpu.train(x[y].T @ x[y] / y.sum(), x.T @ x / 500, float(y.mean()))
    assert ((x @ w > 0) == y).mean() > 0.95


def brute_runs(texts, least):
    lines = [t.split("\n") if t else [] for t in texts]
    words = [[len(x.split()) for x in d] for d in lines]
    gone = [set() for _ in texts]
    seen = {}
    for d, own in enumerate(lines):
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                n = sum(words[d][i:j])
                if n >= least:
                    key = tuple(own[i:j])
                    if key in seen:
                        gone[d].update(range(i, j))
                    seen.setdefault(key, (d, i))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_runs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(12)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [set() for _ in texts]
    for r in linedup.runs(docs, 8).collect():
        got[r.doc_id].update(range(r.start_line, r.start_line + r.n_lines))
    assert got == brute_runs(texts, 8)


@pytest.mark.parametrize("seed", range(2))
def test_what_stripping_leaves(spark, seed):
    rng = random.Random(seed + 10)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(12)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(14)]
    want = {}
    for d, (text, gone) in enumerate(zip(texts, brute_runs(texts, 8), strict=True)):
        rest = [x for i, x in enumerate(text.split("\n")) if i not in gone]
        if rest:
            want[d] = "\n".join(rest)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    rows = linedup.strip(docs, 8).collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "documents", "embeddings", "benchmark", "labels", "conversations"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


def test_segmentations(spark, documents):
    some = documents.limit(60)
    rows = lattice.decode(lattice.encode(some, k=4)).join(some.select("doc_id", "text"), "doc_id").collect()
    assert all(r.round_trip and r.decoded == r.text for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(len({tuple(x.ids) for x in g}) == len(g) for g in by.values())
    for g in by.values():
        p = [x.perturbed for x in sorted(g, key=lambda x: x.sample)]
        assert p == sorted(p, reverse=True)
    assert all(r.log_inclusion <= 1e-9 for r in rows)


def all_segmentations(v, text):
    """Every path of a text with its normalised log probability: characters without a piece take byte pieces."""
    raw = b" " + text.encode() if text else b""
    ids = {b: i for i, b in enumerate(v.bytes) if len(b) and not (len(b) == 1 and i in set(v.byte_id.tolist()))}
    heads = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
    found = {len(raw): [((), 0.0)]}
    for a, z in zip(heads[-2::-1], heads[:0:-1], strict=True):
        out = [((ids[raw[a:e]], *rest), v.logw[ids[raw[a:e]]] + w) for e in heads if e > a and raw[a:e] in ids for rest, w in found[e]]
        if raw[a:z] not in ids:
            own = tuple(int(v.byte_id[x]) for x in raw[a:z])
            out += [((*own, *rest), sum(v.logw[i] for i in own) + w) for rest, w in found[z]]
        found[a] = out
    total = np.logaddexp.reduce([w for _, w in found[0]])
    return {ids: w - total for ids, w in found[0]}


@pytest.mark.parametrize("text", ["a", "the cat", "thing", "é ж", "日本 x🙂", "aaaa", "12 34", "  b\n", ""])
def test_all_segmentations_come_once_each(text):
    v = lattice.vocabulary(lattice.MODEL, 1.0)
    want = all_segmentations(v, text)
    raw = np.frombuffer(text.encode(), np.uint8)
    k = min(len(want), 60) + 1
    found = lattice.Search(lattice.Lattice(v), raw, np.array([0, len(raw)]), np.array([77], np.uint64), k)
    got = [tuple(found.lat.piece[p.edge].tolist()) for p, has in zip(found.paths, found.has, strict=True) if has[0]]
    assert len(got) == len(set(got)) == min(len(want), k) and set(got) <= set(want)
    for ids, p in zip(got, found.paths, strict=False):
        assert abs(found.lat.logp[p.edge].sum() - want[ids]) < 1e-9
    shown = [x[0] for x in found.perturbed[: len(got)]]
    assert shown == sorted(shown, reverse=True) and (found.kappa[0] < shown[-1] if len(want) > k else found.kappa[0] == -np.inf)


@pytest.mark.parametrize("text, k", [("the", 2), ("thing", 3)])
def test_samples_without_replacement_follow_the_model(text, k):
    v = lattice.vocabulary(lattice.MODEL, 0.3)
    p = {ids: np.exp(w) for ids, w in all_segmentations(v, text).items()}
    n = 20_000
    raw = np.frombuffer(text.encode() * n, np.uint8)
    found = lattice.Search(lattice.Lattice(v), raw, np.arange(n + 1) * len(text), lattice.T.mix(np.arange(n, dtype=np.uint64)), k)
    ids = [[tuple(x.tolist()) for x in np.split(found.lat.piece[q.edge], q.bounds[1:-1])] for q in found.paths]
    count = Counter(zip(*ids, strict=True))
    for drawn in itertools.permutations(sorted(p, key=p.get)[-6:], k):
        want, left = 1.0, 1.0
        for x in drawn:
            want, left = want * p[x] / left, left - p[x]
        assert abs(count[drawn] / n - want) < 5 * np.sqrt(want / n) + 2e-4
    # an inclusion score is the chance of exceeding kappa, so inverse scores are without bias
    weight = np.zeros(n)
    for q, own in zip(found.paths, ids, strict=True):
        logp = np.array([np.log(p[x]) for x in own])
        weight += np.exp(logp) / -np.expm1(-np.exp(logp - found.kappa))
    assert abs(weight.mean() - 1) < 5 * weight.std() / np.sqrt(n)


def test_solved_units_and_slices_change_nothing(spark, documents, monkeypatch):
    some = documents.limit(40)
    rows = [(r.doc_id, r.text) for r in some.collect()]
    v = lattice.vocabulary(lattice.MODEL, 1.0)

    def paths():
        lat, out = lattice.Lattice(v), []
        for part in (rows[:7], rows[7:], rows[3:5]):
            raw = [t.encode() for _, t in part]
            found = lattice.Search(lat, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lattice.T.mix(np.array([d for d, _ in part], np.uint64)), 3)
            out += [lat.piece[p.edge].tolist() for p in found.paths] + [np.round(x, 6).tolist() for x in found.perturbed]
        return out

    first = paths()
    for name, small in (("SLICE", 50), ("EARLY", 0), ("SOLVED", 1), ("HIGHEST", 1e9)):
        with monkeypatch.context() as m:
            m.setattr(lattice, name, small)
            assert paths() == first


def test_first_samples_follow_the_model(spark):
    docs = spark.createDataFrame([(i, "thing") for i in range(4000)], "doc_id long, text string")
    first = [(tuple(r.ids), r.log_prob) for r in lattice.encode(docs, k=1).collect()]
    count, prob = Counter(x for x, _ in first), dict(first)
    for ids, n in count.most_common(3):
        p = np.exp(prob[ids])
        assert abs(n / 4000 - p) < 4 * np.sqrt(p * (1 - p) / 4000) + 1e-3


def test_licences_against_a_regex(spark, documents):
    got = Counter((r.doc_id, r.licence) for r in licences.scan(documents).collect())
    want = Counter()
    phrase = {n: [" ".join(re.findall(r"[^\W_]+", p.lower())) for p in ps] for n, ps in licences.TEMPLATES.items()}
    for r in documents.collect():
        text = " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.lower())) + " "
        for n, ps in phrase.items():
            if len(ps) == 1 and (k := text.count(f" {ps[0]} ")):
                want[r.doc_id, n] = k
    assert got == want and want


def test_licence_with_several_phrases(spark):
    mit = licences.TEMPLATES["MIT"]
    rows = [(1, "x y " + ",\n some holder ".join(mit) + " z"), (2, " ".join(mit[:2])), (3, " ".join(reversed(mit))), (4, mit[0] + " w" * 100 + " ".join(mit[1:]))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licence, r.start_word) for r in got] == [(1, "MIT", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_phrases_against_brute_force(spark, seed):
    """Texts of few words with templates of one to three phrases; a chain may leave out a nearer place of a phrase to reach the next one."""
    rng = random.Random(seed)
    texts = {"A": ["a b", "c d", "a e"], "B": ["d a b"], "C": ["b c", "e e"]}
    docs = [" ".join(rng.choices("abcde", k=rng.randint(0, 80))) for _ in range(60)]
    templates = licences.Templates(texts)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    posts, _ = templates.index(licences.frequencies(frame, templates))
    anchored = {templates.names[t]: which for t, which, _, _ in posts}
    want = Counter()
    for d, text in enumerate(docs):
        w = text.split()
        for name, phrases in texts.items():
            parts = [p.split() for p in phrases]
            chains = [[]]
            for p in parts:
                here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
                chains = [[*c, i] for c in chains for i in here if not c or 0 <= i - c[-1] - len(parts[len(c) - 1]) <= 4]
            by = defaultdict(list)
            for c in chains:
                by[c[anchored[name]]].append((c[0], c[-1] + len(parts[-1])))
            for spans in by.values():
                begin = max(b for b, _ in spans)
                want[d, name, begin, min(e for _, e in spans) - begin] += 1
    got = Counter((r.doc_id, r.licence, r.start_word, r.n_words) for r in licences.scan(frame, texts, 4).collect())
    assert got == want and len(want) > 20


@pytest.fixture(scope="module")
def fingerprinted(documents):
    rows = simhash.fingerprint(documents).filter("f0 is not null").collect()
    return rows, np.array([[r.f0, r.f1, r.f2, r.f3] for r in rows], np.int64).view(np.uint64)


def test_near_copies_against_brute_force(documents, fingerprinted):
    rows, fp = fingerprinted
    near = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= 40) + i + 1]
    label = components(len(fp), near)
    found = {r.doc_id: r for r in simhash.groups(documents).collect()}
    hit = sum(found[rows[i].doc_id].group == found[rows[j].doc_id].group for i, j in near)
    assert near and hit >= 0.98 * len(near)
    assert set(found) == {r.doc_id for r in rows}
    assert all(label[i] == label[j] for i, j in itertools.combinations(range(len(fp)), 2) if found[rows[i].doc_id].group == found[rows[j].doc_id].group)
    own, back = np.unique(fp, axis=0, return_inverse=True)
    links = [(np.bitwise_count(own ^ x).sum(1) <= 40).sum() - 1 for x in own]
    copies = np.bincount(back) - 1
    assert 0.95 * sum(links) <= sum({back[i]: found[r.doc_id].links for i, r in enumerate(rows)}.values()) <= sum(links)
    assert all(found[r.doc_id].links <= links[back[i]] and found[r.doc_id].copies == copies[back[i]] for i, r in enumerate(rows))
    for g in {r.group for r in found.values()}:
        assert [r.doc_id for r in found.values() if r.group == g and r.kept] == [g] == [min(r.doc_id for r in found.values() if r.group == g)]


def test_near_copies_by_their_texts(documents):
    """Pairs that share 85 % of their distinct words, over all pairs."""
    docs = documents.collect()
    words = [set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.lower())) for r in docs]
    group = {r.doc_id: r.group for r in simhash.groups(documents).collect()}
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if len(words[a]) > 5 and len(words[a] & words[b]) >= 0.85 * len(words[a] | words[b])]
    assert len(near) > 50 and np.mean([group[docs[a].doc_id] == group[docs[b].doc_id] for a, b in near]) >= 0.9


@pytest.mark.parametrize("width, most", [(16, 40), (20, 40), (26, 40), (16, 24)])
def test_rings_find_pairs_at_the_full_distance(spark, width, most, monkeypatch):
    """Pairs that differ in exactly `most` random bits, whatever the width that the number of fingerprints asks for."""
    rng = np.random.default_rng(9)
    n = 300
    a = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    b = a.copy()
    b[np.arange(n)[:, None], np.argsort(rng.random((n, 256)), axis=1)[:, :most]] ^= 1
    fp = np.packbits(np.concatenate([a, b]), axis=1, bitorder="little").view(np.int64)
    prints = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(fp)], "fid long, f0 long, f1 long, f2 long, f3 long").cache()
    monkeypatch.setattr(simhash, "width_of", lambda _: width)
    found = {(r.a, r.b) for r in simhash.close_pairs(prints, most, 0.95).collect()}
    assert found <= {(i, i + n) for i in range(n)} and len(found) >= 0.91 * n


@pytest.mark.parametrize("most, task, work", [(40, 1 << 20, 1 << 22), (40, 250, 1 << 22), (40, 1 << 20, 1 << 12), (7, 250, 1 << 12), (3, 1 << 20, 1 << 22), (0, 1 << 20, 1 << 22), (90, 1 << 20, 1 << 12)])
def test_no_close_pair_is_left_out(spark, most, task, work, monkeypatch):
    """Pairs at the full distance and one bit beyond it, chance pairs and a dense cluster, in one task and in several: the same pairs as brute force, each once."""
    rng = np.random.default_rng(12)
    n = 400
    bits = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    far = np.argsort(rng.random((n, 256)), axis=1)
    far[: n // 4] = (np.arange(256) + rng.integers(0, 256, (n // 4, 1))) % 256  # differing bits beside each other
    apart = np.zeros((n, 256), np.uint8)
    np.put_along_axis(apart, far, (np.arange(256) < most + np.arange(n)[:, None] % 4 // 3).astype(np.uint8), 1)
    cluster = bits[:1] ^ (rng.random((60, 256)) < 0.02).astype(np.uint8)
    fp = np.unique(np.packbits(np.concatenate([bits, bits ^ apart, cluster]), axis=1, bitorder="little").view(np.uint64), axis=0)
    want = {(i, j) for i in range(len(fp)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(1) <= most) + i + 1).tolist()}
    prints = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(fp.view(np.int64))], "fid long, f0 long, f1 long, f2 long, f3 long").cache()
    monkeypatch.setattr(simhash, "TASK", task)
    monkeypatch.setattr(simhash, "WORK", work)
    found = [(r.a, r.b) for r in simhash.close_pairs(prints, most, 0.95).collect()]
    assert len(found) == len(set(found)) and set(found) == want and (len(want) >= 300 or not most)


def test_all_links_of_the_documents(documents, fingerprinted):
    rows, fp = fingerprinted
    own, back = np.unique(fp, axis=0, return_inverse=True)
    near = [np.flatnonzero(np.bitwise_count(own ^ x).sum(1) <= 40) for x in own]
    label = components(len(own), [(i, j) for i in range(len(own)) for j in near[i].tolist() if i < j])
    first = {}
    for i, r in enumerate(rows):
        first[label[back[i]]] = min(first.get(label[back[i]], r.doc_id), r.doc_id)
    found = {r.doc_id: (r.group, r.links) for r in simhash.groups(documents).collect()}
    assert found == {r.doc_id: (first[label[back[i]]], len(near[back[i]]) - 1) for i, r in enumerate(rows)}


def test_fingerprints_against_plain_python():
    texts = ["a b a c", "", "one", " ".join(f"w{i % 700}" for i in range(3000)), "Ä ä b"]
    raw = [t.encode() for t in texts]
    fp, count = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for x, c, text in zip(fp, count, texts, strict=True):
        h = np.unique(lattice.T.hash_words(text) >> np.uint64(simhash.ROWS)) if text else np.zeros(0, np.uint64)
        bits = np.array([[int(lattice.T.mix(np.array([y + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)]))[0]) >> i & 1 for k in range(4) for i in range(64)] for y in h]).reshape(-1, 256)
        want = np.packbits((2 * bits.sum(0) > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)
        assert c == len(h) and (x == want).all()


def test_caps_against_brute_force(spark):
    """Random vectors, pairs of near copies, a dense cluster of 150 and copies that are equal."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    near = x[rng.integers(0, 1500, 300)]
    near = near / np.linalg.norm(near, axis=1, keepdims=True) * 8 + rng.standard_normal((300, 64)) * 0.3
    x = np.concatenate([x, near, x[0] + rng.standard_normal((150, 64)) * 0.1, x[5:45], x[5:45]])
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cosine = u @ u.T
    pairs = list(zip(*np.nonzero(np.triu(cosine >= 0.95, 1)), strict=True))
    _, back = np.unique(u, axis=0, return_inverse=True)
    rows = {r.vec_id: r for r in capfilter.groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert set(rows) == set(range(len(x)))
    assert len(pairs) > 10_000 and np.mean([rows[i].group == rows[j].group for i, j in pairs]) >= 0.97
    label = components(len(x), pairs)
    assert all(label[v] == label[r.group] for v, r in rows.items())
    assert all(r.copies == (back == back[v]).sum() - 1 for v, r in rows.items())
    links = np.array([len({back[j] for j in np.flatnonzero(cosine[i] >= 0.95)} - {back[i]}) for i in range(len(x))])
    found = np.array([rows[i].links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_signs_lose_no_close_pair():
    rng = np.random.default_rng(3)
    for least in (0.5, 0.9, 0.95, 0.99):
        x, z = rng.standard_normal((2, 4000, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = least * x + np.sqrt(1 - least**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        side = rng.standard_normal((48, capfilter.SIGNS))
        apart = ((x @ side > 0) != (y @ side > 0)).sum(1)
        assert (apart <= capfilter.differing(least)).all() and capfilter.differing(least) < (64 if least >= 0.9 else 80)


def test_list_decoding_finds_every_filter():
    code = capfilter.Code(24, 0, 30, 10)
    x = np.random.default_rng(0).standard_normal((40, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ code.turn
    p = [y[:, a:b] @ c for a, b, c in zip(code.cuts[:-1], code.cuts[1:], code.books, strict=True)]
    full = (p[0][:, :, None] + p[1][:, None, :]).reshape(40, -1)
    assert set(zip(*map(np.ndarray.tolist, code.decode(x)), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(full >= code.bar)), strict=True))


@pytest.mark.parametrize("dim, n", [(64, 2_000), (64, 200_000), (64, 5_000_000), (2, 200_000), (3, 200_000), (5, 200_000), (8, 5_000_000), (12, 200_000), (256, 200_000)])
def test_recall_of_caps_at_any_size(dim, n):
    rng = np.random.default_rng(7)
    x, z = rng.standard_normal((2, 150, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    size, met, n_filters = capfilter.book_size(dim, n, 0.95, 12, 4), set(), 0
    for c in range(capfilter.CODES):
        code = capfilter.Code(dim, c, size, 12)
        a, b = (set(zip(*map(np.ndarray.tolist, code.decode(v.astype(np.float32))), strict=True)) for v in (x, y))
        met |= {row for row, _ in a & b}
        n_filters += len(a)
    assert len(met) >= 0.93 * 150
    assert 24 < n_filters / 150 < 48


@pytest.mark.parametrize("dim, least", [(2, 0.9999), (3, 0.999), (5, 0.97)])
def test_caps_in_few_dimensions(spark, dim, least):
    x = np.random.default_rng(4).standard_normal((400, dim))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = list(zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True))
    group = {r.vec_id: r.group for r in capfilter.groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), least).collect()}
    assert len(near) > 20 and np.mean([group.get(i, -1) == group.get(j, -2) for i, j in near]) >= 0.9


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing_round_trip(body, chunk):
    framed = warcseg.frame(body, chunk)
    assert warcseg.unframe(framed) == (body, True)
    assert warcseg.unframe(framed[:-1])[1] is False


def test_archives_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(warcseg, "PIECE", 3000)
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i * 997 % 20_000)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    archive = warcseg.archive(pages).cache()
    assert archive.count() > 100
    rows = warcseg.reassemble(warcseg.records(archive)).collect()
    assert sorted((r.target_uri, len(r.body), r.status) for r in rows) == sorted((f"u{i}", i * 997 % 20_000, "ok") for i in range(200))


def test_a_page_of_many_segments(spark):
    big = "0123456789abcdef" * 400_000
    rows = warcseg.reassemble(warcseg.records(warcseg.archive(spark.createDataFrame([(1, "u", big), (2, "v", "x")], "page_id long, url string, html string")))).collect()
    assert {(r.target_uri, r.body.decode() == (big if r.target_uri == "u" else "x"), r.status) for r in rows} == {("u", True, "ok"), ("v", True, "ok")}


def test_segment_faults(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"0123456789" * 3

    def parts(o, picks, total=len(body), change=None):
        for k in picks:
            piece = body[(k - 1) * 20 : k * 20]
            yield (o if k == 1 else f"{o}{k}", "response", "u", k, None if k == 1 else o, total if k == 3 else None, change or piece)

    rows = list(itertools.chain(parts("ok", (3, 1, 2)), parts("gap", (1, 3)), parts("end", (1, 2)), parts("len", (1, 2, 3), 48), parts("orphan", (2, 3)), parts("twice", (1, 2, 3, 2)), parts("clash", (1, 2, 3)), parts("clash", (2,), change=b"?")))
    rows.append(("bad", "response", "u", None, None, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab"))
    got = {r.origin_id: r.status for r in warcseg.reassemble(spark.createDataFrame(rows, warcseg.RECORD)).collect()}
    assert got == {"ok": "ok", "gap": "missing", "end": "missing", "len": "length", "orphan": "missing", "twice": "ok", "clash": "conflict", "bad": "framing"}
