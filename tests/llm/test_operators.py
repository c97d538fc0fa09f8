"""Each operator against brute force, the library or held-out labels, and on odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from docspark.llm import bpe, fingerprints, language, licenses, neighbours, ngram_join, packing, pii, quality, queries, url_filter

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 3000), (7, "Ünï cødé 😀 text here"), (None, "no id at all here"), (8, "a<|endoftext|>b")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("lang", F.lit("en")).withColumn("start", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, html string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _sets(rows, k):
    out = {}
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _components(sets, num, den):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join_is_exact(docs, k, num):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rows += [(10_000 + i, " ".join(base[:i] + [f"w{i}"] + base[i + 1 :])) for i in range(24)]  # near copies, most of them apart
    rows += [(20_000 + i, " ".join(base * 3 + [f"e{i}"])) for i in range(20)]
    got = ngram_join.ngram_jaccard_join(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), k, num, 100).collect()
    sets = _sets(rows, k)
    want = _components(sets, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_counts_all_links(spark, monkeypatch):
    """Near copies of one text, all within the threshold of each other or only of the text, in one block and in several."""
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    rows += [(1 + i, " ".join(base[: 5 * i] + [f"x{i}"] + base[5 * i + 1 :])) for i in range(30)]
    rows += [(100 + i, " ".join(base[: 6 * i] + [f"y{i}", f"z{i}"] + base[6 * i + 2 :])) for i in range(30)]
    rows += [(200, rows[0][1]), (201, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 97), (5, 95)):
        sets = _sets(rows, k)
        different = {frozenset(s) for s in sets.values()}
        near = lambda a, b: 100 * len(a & b) >= num * len(a | b)
        want = {i: sum(frozenset(s) != t and near(s, t) for t in different) for i, s in sets.items()}
        assert len(set(want.values())) > 1
        for block, large in ((256, 2048), (7, 2048), (7, 20)):
            monkeypatch.setattr(ngram_join, "BLOCK", block)
            monkeypatch.setattr(ngram_join, "LARGE", large)
            assert {r.doc_id: r.links for r in ngram_join.ngram_jaccard_join(df, k, num, 100).collect()} == want


def test_ngram_join_divides_large_groups(spark, monkeypatch):
    """Groups around several centres in one region: cells and windows lose no link and count none twice."""
    monkeypatch.setattr(ngram_join, "LARGE", 30)
    random = np.random.default_rng(11)
    nodes = []
    for centre in range(5):
        base = random.integers(0, 2**62, 200)
        for _ in range(36):
            nodes.append(np.unique(np.concatenate([base[random.random(200) > 0.07], random.integers(0, 2**62, 6)])))
    names = random.permutation(len(nodes)) * 7 + 3
    sets = spark.createDataFrame([(int(n), [int(x) for x in v]) for n, v in zip(names, nodes)], "node long, items array<long>")
    member = spark.createDataFrame([(1, int(n)) for n in names], "top long, node long")
    divided = ngram_join._divided(member.select(F.col("top").alias("cell"), "top", "node", F.lit(True).alias("inner")), sets, 80, 100)
    sizes = [r["count"] for r in divided.groupBy("cell").count().collect()]
    assert len(sizes) > 1 and max(sizes) < len(nodes)
    got = {r.node: r.links for r in ngram_join._links(member, sets, 80, 100).groupBy("node").agg(F.sum("links").alias("links")).collect()}
    want = {}
    for n, v in zip(names, nodes):
        found = sum(m != n and 100 * len(np.intersect1d(v, w)) >= 80 * len(np.union1d(v, w)) for m, w in zip(names, nodes))
        want |= {int(n): found} if found else {}
    assert got == want and len(set(want.values())) > 1


def test_ngram_join_odd(odd, none):
    got = ngram_join.ngram_jaccard_join(odd, 3, 90, 100).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == by[1] and by[1][0] == (0, 1) and by[2][0] == (0, 2) and by[3][0] == (0, 3)
    assert by[4] == [(1, 4)] and by[5] == [(1, 4), (1, 4)]
    assert ngram_join.ngram_jaccard_join(none).count() == 0


def test_url_rules(spark):
    rows = [(1, "HTTP://A.Example.COM/en/70?x", "<a href='http://b.example.com/'>"), (2, "http://a.example.com/en/8", None), (3, None, None), (4, "nothing", ""), (5, "https://x.net/de/8", ""), (6, "https://example.net/de/81#f", ""), (7, "http://notcom/en/", ""), (8, "http://b.example.com", "")]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("com/en/", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow") == (got[4].host, got[4].path, got[4].rule, got[4].verdict)
    assert got[5].rule == "net/de/" and got[6].rule == "example.net/de/8" and got[7].rule is None and got[8].path == ""


def test_url_rules_are_the_contracts(spark):
    """Each rule's word, and the longer rule over the shorter one."""
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.net/de/8": ("net/de/", "allow"), "http://m.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://b.org/es/": ("org/es/", "block")}
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect()}
    assert got == dict(enumerate(urls.values()))


def test_url_verdicts_follow_links(spark, none):
    """Hosts without a rule, against PageRank by matrices over links that brute force finds."""
    random = np.random.default_rng(8)
    hosts = [f"h{i}.example.{'com' if i % 4 == 0 else 'net' if i % 4 == 1 else 'io'}" for i in range(40)]
    rows = []
    for i in range(300):
        host = hosts[int(random.integers(40))]
        path = ["/en/1", "/en/7", "/de/8", "/de/1", "/fr/"][int(random.integers(5))]
        cited = [hosts[int(x)] for x in random.integers(0, 40, int(random.integers(0, 4)))]
        rows.append((i, f"https://{host}{path}", " ".join(f'<a href="http://{c}/x">' for c in cited)))
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    known = {r[1].split("/")[2] for r in rows}
    sites = {h: h.split(".", 1)[1] for h in known if h.count(".") >= 3}
    names = sorted(known | set(sites.values()))
    links, seeds = np.zeros((len(names), len(names))), np.zeros((2, len(names)))
    for i, url, html in rows:
        host = url.split("/")[2]
        for cited in set(re.findall(r"h[0-9]+[.]example[.][a-z]+", html)) & known - {host}:
            links[names.index(host), names.index(cited)] += 1
        if got[i].rule:
            seeds[int(got[i].verdict == "block"), names.index(host)] += 1
    score = []
    for kind, way in ((0, links), (1, links.T)):
        move = way / np.maximum(way.sum(1, keepdims=True), 1)
        start = seeds[kind] / seeds[kind].sum()
        rank = start
        for _ in range(20):
            rank = 0.85 * rank @ move + 0.15 * start
        score.append(rank)
    judged = 0
    for i, url, _ in rows:
        at = names.index(url.split("/")[2])
        assert abs(got[i].trust - score[0][at]) < 1e-9 and abs(got[i].distrust - score[1][at]) < 1e-9
        if got[i].rule is None and abs(score[1][at] - score[0][at]) > 1e-12:
            judged += 1
            assert got[i].verdict == ("block" if score[1][at] > score[0][at] else "allow")
    assert judged > 50 and len({r.verdict for r in got.values() if r.rule is None}) == 2
    assert url_filter.url_verdicts(none.selectExpr("doc_id as page_id", "text as url", "html")).count() == 0


def test_spread_is_personalised_pagerank(spark):
    links = [("a", "b", 3), ("b", "c", 1), ("a", "c", 1), ("c", "a", 2), ("d", "a", 1)]
    seeds = [("a", 2, 0), ("c", 0, 1), ("b", 2, 0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(spark.createDataFrame(links, "source string, target string, n long"), spark.createDataFrame(seeds, "host string, trust long, distrust long")).collect()}
    hosts = "abcd"
    for kind in (0, 1):
        m = np.zeros((4, 4))
        for s, t, n in links:
            s, t = (s, t) if kind == 0 else (t, s)
            m[hosts.index(s), hosts.index(t)] += n
        m = m / np.maximum(m.sum(1, keepdims=True), 1)
        seed = np.zeros(4)
        for h, *w in seeds:
            seed[hosts.index(h)] = w[kind]
        seed, rank = seed / seed.sum(), seed / seed.sum()
        for _ in range(20):
            rank = 0.15 * seed + 0.85 * rank @ m
        assert all(abs(got.get(h, (0, 0))[kind] - rank[i]) < 1e-9 for i, h in enumerate(hosts))


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    own = np.array([0] * 70 + [1] * 5 + [2] * 33 + [4])
    score, moves = rng.normal(size=(len(own), 3)), rng.normal(size=(3, 3))
    got = language.marginals(score, own, moves)
    for o in set(own):
        e, m = np.exp(score[own == o]), np.exp(moves)
        a, forward = np.full(3, 1 / 3), []
        for x in e:
            a = (a @ m) * x
            a /= a.sum()
            forward.append(a)
        b, backward = np.ones(3), []
        for x in e[::-1]:
            backward.append(b)
            b = m @ (b * x)
            b /= b.sum()
        want = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(want / want.sum(1, keepdims=True), got[own == o])


def test_language(spark, sf, docs, odd, none):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.languages(docs, docs).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    few = language.languages(odd, docs).collect()
    assert len(few) == len(ODD) and {r.lang_pred for r in few if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.languages(none, none).count() == 0
    assert {r.lang_pred for r in language.languages(odd, none).collect()} == {"und"}


def test_language_learns_every_label(spark):
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:130]
    rows = [(i, f"word{i} other{i}", f"l{n:03}") for n, i in enumerate(learned)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.labelled_sample(df, df.selectExpr("doc_id", "lang as label"), 5, 100)
    assert sorted(r.label for r in sample.collect()) == [f"l{n:03}" for n in range(130)]


def test_sample_is_bounded_and_whole(spark):
    """At most so many rows and characters of each label, never part of a text, none that is held out."""
    rows = [(i, "x" * (1 + i % 50), "a" if i % 3 else "b") for i in range(600)] + [(7, "twice", "a"), (None, "x", "a"), (900, None, "b"), (901, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    texts = collections.defaultdict(set)
    for i, text, _ in rows:
        texts[i].add(text)
    for count, characters in ((20, 10_000), (500, 300)):
        got = language.labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "label"), count, characters).collect()
        for label in "ab":
            some = [r for r in got if r.label == label]
            assert 0 < len(some) <= count and sum(len(r.text) for r in some[1:]) <= characters
        assert all(r.text in texts[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)


def test_quality(spark, sf, docs, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.quality_scores(odd, labels.limit(0)).count() == len(ODD)
    assert quality.quality_scores(none, labels).count() == 0


def test_personal_data_adds_spans(spark):
    """What the base patterns miss is added where the labelers speak for it, on a table as small as this one too."""
    rows = [
        (1, "write to john [at] mail (dot) com please"),
        (2, "call (415) 555-2671 now"),
        (3, "my credit card 4111 1111 1111 1112 ok"),
        (4, "the server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up"),
        (5, "order no. 415-555-2671 and 4111 1111 1111 1112 parts"),
        (6, "mail a.b@c.de today"),
        (7, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).select("doc_id", pii.joined("spans").alias("spans")).collect()}
    assert got == {1: "email:9:33", 2: "phone:5:19", 3: "card:15:34", 4: "ip:11:50", 5: "", 6: "email:5:13", 7: ""}


def test_label_model_and_classifier():
    """Reliabilities are learned: votes that agree are believed more than before, and the classifier follows beliefs."""
    good, bad, odd = (1, 1, 0, 1, 1), (-1, 0, -1, -1, -1), (1, 0, -1, -1, -1)
    few, many = pii._em([(good, 1), (bad, 1), (odd, 1)]), pii._em([(good, 50_000), (bad, 50_000), (odd, 1)])
    assert many[good] >= few[good] > 0.9 and many[bad] <= few[bad] < 0.1
    rows = [(good, (False,) * 5, 900), (bad, (True,) * 5, 900), (odd, (True,) * 5, 10)]
    weights, belief = pii._trained(rows), pii._em([(v, n) for v, _, n in rows])
    for v, m, _ in rows:
        p = 1 / (1 + np.exp(-np.dot(weights, pii._row(v, m))))
        assert abs(p - belief[v]) < 0.15


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda d, m: 13 <= len(d) <= 19 and (sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 9 <= len(d) <= 15),
]


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, f in BASE for m in re.finditer(p, text or "") if f([int(c) for c in m[0] if c.isdigit()], m[0]))


def test_pii(spark, docs, odd, none):
    texts = ["a@b.c@d.e a@b.c_d@e.f 😀x@y.zz 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "+1 (302) 555-8032 x 4111 1111 1111 1111 x 4111-1111-1111-1112 +", "john [at] mail (dot) com", "9" * 6000 + " x@" + "a.b" * 3000, "x" * 20000 + "@", " ".join(f"u{i}@h{i}.com" for i in range(600))]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.personal_data(df, ["doc_id", "text"]).select("doc_id", pii.joined("base").alias("base"), pii.joined("spans").alias("spans"), pii.redacted().alias("clean")).collect()
    for r in got:
        assert r.base == _base(dict(rows)[r.doc_id]), r.doc_id
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert next(r.clean for r in got if r.doc_id == 10_001).startswith("<PHONE> x <CARD> x")
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(none).count() == 0


def test_pii_query_counts_base_spans(spark, tmp_path):
    """Spans that the method adds are listed, but not counted."""
    rows = [(1, "3138160609473914 77667++2 and my credit card 4111 1111 1111 1112 ok"), (2, "mail a.b@c.de, ip 10.0.0.1, +1 302 555 8032, card 4111 1111 1111 1111"), (3, "write to john [at] mail (dot) com please"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    for i, text in rows:
        base = _base(text)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[3].spans == "email:9:33" and got[3].n_email == 0


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    want = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.select("doc_id", "text").collect()}
    got = sorted(packing.concatenate_and_cut(docs, path, window=512).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    parts = collections.defaultdict(dict)
    for r in got:
        assert r.sequence_id * 512 + r.offset == at and r.offset + r.length <= 512 and r.doc_tokens * 4 == len(want[r.doc_id])
        parts[r.doc_id][r.start] = bytes(r.ids)
        at += r.length
    assert all(b"".join(x for _, x in sorted(parts[i].items())) == ids for i, ids in want.items())
    assert {r.doc_id for r in packing.concatenate_and_cut(odd, path).collect()} == {i for i, _ in ODD}
    assert packing.concatenate_and_cut(none, path).count() == 0


def test_bpe(docs, odd, none):
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    for df in (docs, odd):
        got = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
        left = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            left[r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
        assert left == collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got)
    assert bpe.bpe_encode(none, path).count() == 0


def test_bpe_on_random_pieces():
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    library, own = Tokenizer.from_file(path), bpe.Bpe(open(path).read())
    rng = np.random.default_rng(1)
    for letters in ("abehit ", "aaab", "0123 .,!", "éàü日本 x"):
        for _ in range(40):
            text = "".join(rng.choice(list(letters), 60))
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_fingerprints(docs, odd, none):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for i, (doc_id, text) in enumerate(rows):
        n = len(text) // 3
        edited = text[: len(text) - n] + rows[(i + 1) % len(rows)][1][:n]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[doc_id].n_chars == len(text)
        assert 0 <= got[doc_id].near_edited <= 1 and 0 <= got[doc_id].near_next <= 1
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.3
    same = collections.defaultdict(set)
    for doc_id, text in rows:
        same[text].add(got[doc_id].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints.fingerprints(odd).count() == len(ODD) and fingerprints.fingerprints(none).count() == 0


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    odd = [(900_000, None), (900_100, [0.0] * 64), (900_200, [float("nan")] * 64), (900_300, [None] * 64), (None, [1.0] * 64), (900_400, [1.0, 2.0])]
    odd += [(900_500 + i, [0.5] * 64) for i in range(40)]
    both = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("node", F.lit(3))
    rows |= {i: np.array(v) for i, v in odd[6:]}
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(both, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 100 == 0}
    share = []
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        share.append(len({i for i, _ in found} & {i for _, i in want}) / 10)
        assert len(found) == 10 and all(abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-12 for i, s in found)
    assert np.mean(share) >= 0.9 and [i for i, _ in got[900_500]] == list(range(900_501, 900_511))


def test_neighbours_look_at_a_part(spark):
    """Recall against brute force on more vectors than a shard holds, and how many of them a query looks at."""
    random = np.random.default_rng(3)
    data = np.repeat(random.normal(size=(300, 24)) * 3, 40, axis=0) + random.normal(size=(12_000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    share = []
    for q in range(0, 12_000, 100):
        far = ((data - data[q]) ** 2).sum(1)
        far[q] = np.inf
        share.append(len(got[q] & set(np.argsort(far, kind="stable")[:10])) / 10)
    assert len(got) == 120 and np.mean(share) >= 0.9
    forest = neighbours.Forest(data[::2], 32, 7)
    assert forest.least(10, 0.97, 64) <= 0.25 * 6000
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(none, F.col("vec_id") % 100 == 0).count() == 0 and neighbours.nearest(df, F.lit(False)).count() == 0


def test_licenses(spark, docs, odd, none):
    rows = [(i, "é Foo bar " * 50 + text + " baz qux" * 30) for i, (_, _, text) in enumerate(licenses.TEMPLATES)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.template) for r in got} >= {(i, name) for i, (name, _, _) in enumerate(licenses.TEMPLATES)}
    for r in got:
        assert rows[r.doc_id][1][r.start : r.end] and r.containment >= 0.8
    line = "This work is licensed under the GNU General Public License, version 3."
    want = {r.doc_id for r in docs.collect() if line in r.text}
    assert {r.doc_id for r in licenses.license_scan(docs).collect() if r.template == "gpl3-line"} == want
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(none).count() == 0


def test_licenses_at_every_place(spark):
    """Against brute force: whole notices at all positions, edited ones, several in a text, nothing that isn't there."""
    random = np.random.default_rng(4)
    names = {name: text for name, _, text in licenses.TEMPLATES}
    plain = lambda text: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    rows, planted = [], []
    for i in range(400):
        words, own = [], []
        for _ in range(int(random.integers(1, 4))):
            words += [f"w{x}" for x in random.integers(0, 900, int(random.integers(0, 90)))]
            name = list(names)[int(random.integers(len(names)))]
            notice = plain(names[name])
            if random.random() < 0.3 and len(notice) > 30:
                notice[int(random.integers(len(notice)))] = "edited"
            own.append((name, len(words), len(words) + len(notice)))
            words += notice
        words += [f"w{x}" for x in random.integers(0, 900, int(random.integers(0, 40)))]
        rows.append((i, " ".join(words)))
        planted.append((words, own))
    got = collections.defaultdict(list)
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id, r.template].append(r)
        found = grams(plain(rows[r.doc_id][1][r.start : r.end])) & grams(plain(names[r.template]))
        assert len(found) / len(grams(plain(names[r.template]))) >= r.containment - 1e-9 >= 0.8 - 1e-9
    lost = 0
    for i, (words, own) in enumerate(planted):
        for name, a, b in own:
            share = len(grams(words[a:b]) & grams(plain(names[name]))) / len(grams(plain(names[name])))
            start, end = len(" ".join(words[:a])) + (a > 0), len(" ".join(words[:b]))
            if share >= 0.8:
                lost += not any(r.start <= start and end <= r.end or r.start < end and start < r.end and share < 1 for r in got[i, name])
    assert lost == 0
    assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), []).count() == 0
