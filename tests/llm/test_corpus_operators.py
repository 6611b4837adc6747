"""Operators on whole tables, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vectide.llm import line_dedup, mixing, near_dup, url_filter, warc
from vectide.llm.sql import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# mixing


def brute_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else part[s] for s in order}
        full |= over


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * i % 50), ["b", "a", None, "é", "hot", "hot", "hot"][i % 7]) for i in range(400)] + [(1, None, "a"), (2, "", "empty"), (None, "x y", "b"), (3, "w w", "hot")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, rate double, target int")
    found = mixing.mix_counts(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = brute_targets(sizes)
    by = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in found)
    assert by == Counter((i, len(WORD.findall(t or "")), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r.source_size] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(targets.values()), rel=0.1)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix_counts(docs.repartition(7)).collect()))
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    expected = Counter()
    for r in found:
        expected[r.doc_id] += r.copies
    assert mixed == +expected and mixing.mix(docs).columns == docs.columns
    odd = docs.withColumnsRenamed({"rate": "row", "target": "copy"}).withColumn("a.b", F.lit(1)).withColumn("__size", F.lit("s"))
    assert Counter(r.doc_id for r in mixing.mix(odd).collect()) == mixed and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_counts(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, "d": 5}, {"a": 0}, {"a": 0, "b": 7}, {None: 3, "x": 4, "y": 1, "z": 900}])
def test_mixing_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(expected[r.source])


# line dedup


def brute_lines(rows):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holders = defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(key(line), ())
            last = max((-1 if rows[i][0] is None else rows[i][0] for i in own), default=None)
            if len(own) < 3 or (-1 if doc is None else doc) == last:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0}, {"max_bits": 1 << 16, "max_broadcast": 0}, {"max_bits": 1 << 5}, {"max_bits": 1 << 7, "max_broadcast": 0}])
def test_line_dedup(spark, monkeypatch, options):
    """Also with so small filters that there are many shards."""
    if options.get("max_bits", 0) < 1 << 10:
        monkeypatch.setattr(line_dedup, "MIN_BITS", 8)
    line = "a line that is shared by MANY documents"
    rows = [(i, f"own line number {i} of this document\n{line}\n  {line.lower()}\t\nshort\n" + ("\nsecond shared line, in every third one" if i % 3 == 0 else "")) for i in range(40)]
    rows += [(None, line), (None, "ééééééééééééééééééééé\nx"), (77, None), (78, ""), (79, "\n\n"), (5, line + "\nagain"), (80, f"{line}\n" * 3000), (81, "y" * 200_000), (82, "ÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀ"), (83, "ééééééééééééééééééééé"), (84, "ééééééééééééééééééééé")]
    docs = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n_lines int, digest string").repartition(5)
    found = sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256", "text")) for r in line_dedup.dedup_lines(docs, **options).collect()), key=str)
    assert found == brute_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0), **options).count() == 0


def test_line_dedup_passes_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", None), (2, None, None, "s")], "doc_id long, text string, lang string, source string")
    rows = line_dedup.dedup_lines(docs, "lang", "source").orderBy("doc_id").collect()
    assert [(r.lang, r.source, r.text) for r in rows] == [("en", None, "a"), (None, "s", "")]


def test_line_dedup_with_clashing_columns(spark):
    line = "a line that is shared by many documents"
    docs = spark.createDataFrame([(i, line, f"{i}", 7, "d") for i in range(4)], "doc_id long, text string, drop0 string, n_lines int, own string")
    for n in (0, 10):
        found = line_dedup.dedup_lines(docs, "drop0", "n_lines", "own", max_broadcast=n)
        assert found.columns == [*line_dedup.RESULT, "drop0", "own"]
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped, r.drop0, r.own) for r in found.collect()) == [(i, line if i == 3 else "", 1, int(i < 3), f"{i}", "d") for i in range(4)]


def test_shards_part_all_keys():
    import numpy as np

    a = np.random.default_rng(2).integers(0, 1 << 64, 4000, dtype=np.uint64)
    for n in (1, 2, 8, 64):
        own = line_dedup.shard(a, n)
        assert set(own.tolist()) == set(range(n))


def test_filters_miss_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    one, two = line_dedup.Seen(1 << 16), line_dedup.Seen(1 << 16)
    one.add(a[:2000], b[:2000])
    two.add(a[1500:], b[1500:])
    one.merge(two.once.bytes.tobytes(), two.twice.bytes.tobytes())
    assert one.once.has(a, b).all() and one.twice.has(a[1500:2000], b[1500:2000]).all()
    assert one.twice.has(a[:1500], b[:1500]).mean() < 0.2
    same = line_dedup.Seen(1 << 16)
    same.add(np.concatenate([a[:5], a[:5]]), np.concatenate([b[:5], b[:5]]))
    assert same.twice.has(a[:5], b[:5]).all()


# near duplicates


def brute_near(rows, words, threshold=80):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def near_rows():
    import random

    rng = random.Random(7)
    rows, doc = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([9, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(4000)}"
            doc += rng.randrange(1, 4)
            rows.append((doc, (" " if rng.random() < 0.5 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in text)))
        rows += [(doc + 100_000 + i, rows[-1][1]) for i in range(group % 3)]
    # a chain: each links to the next, the ends don't
    chain = [f"c{i}" for i in range(120)]
    rows += [(50_000 + k, " ".join(chain[5 * k : 5 * k + 80])) for k in range(8)]
    return [*rows, (60_000, None), (60_001, ""), (60_002, "one two"), (60_003, "ONE  two"), (None, "one two"), (None, None), (None, "alone here"), (60_004, "word " * 30_000)]


@pytest.mark.parametrize("words", [4, 5])
@pytest.mark.parametrize("rounds, few, spread", [(4, 1.0, 64), (3, -1.0, 5), (1, 0.0, 2)])
def test_near_duplicates(spark, monkeypatch, words, rounds, few, spread):
    monkeypatch.setattr(near_dup, "SPREAD", spread)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "FEW", few)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n int, registers string").repartition(6)
    found = sorted((tuple(r) for r in near_dup.near_duplicates(docs, words=words).collect()), key=str)
    expected = brute_near(rows, words)
    fixed = [(d, n, c, True if d is None and n == 0 else (k if d is not None else c is None)) for d, n, c, k in expected]
    assert found == sorted(fixed, key=str)


def test_near_duplicates_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(docs).count() == 0
    assert [tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame([(4, "")], "doc_id long, text string")).collect()] == [(4, 0, 4, True)]


def test_near_duplicates_that_repeat_a_doc_id(spark):
    """Rows of one doc_id and different texts are told apart; rows without doc_id keep one text; passed columns may clash."""
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(5, a, "x"), (5, b, "y"), (2, a + " more", "z"), (5, b, "y"), (2**62 + 9, b + " more", "w"), (None, "n " * 9 + "o", "m"), (None, "n " * 9 + "o", "m"), (None, "p q r s t", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, sig string, key int, kept int").repartition(3)
    found = near_dup.near_duplicates(docs, "sig", "kept", "key")
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept", "sig", "key"]
    got = sorted(((r.doc_id, r.sig, r.component_id, r.kept, r.key) for r in found.collect()), key=str)
    expected = [(5, "x", 2, False), (5, "y", 5, True), (2, "z", 2, True), (5, "y", 5, True), (2**62 + 9, "w", 5, False), (None, "m", None, True), (None, "m", None, True), (None, None, None, True)]
    assert got == sorted([(*e, 1) for e in expected], key=str)


def test_prefix_pairs_are_all_that_are_linked(spark):
    import random

    rng = random.Random(5)
    pool = [rng.randrange(1 << 60) for _ in range(400)]
    sets = []
    for _ in range(12):
        base = rng.sample(pool, rng.choice([5, 12, 40, 60]))
        sets += [{x for x in base if rng.random() > 0.06} | set(rng.sample(pool, rng.randrange(4))) for _ in range(8)]
    component = [i // 3 for i in range(len(sets))]
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    expected = {(i, j) for i in range(len(sets)) for j in range(i) if component[i] != component[j] and linked(sets[i], sets[j])}
    data = spark.createDataFrame([(i, b"".join(e.to_bytes(8, "little") for e in sorted(s))) for i, s in enumerate(sets)], "class long, set binary")
    own = spark.createDataFrame([(i, c) for i, c in enumerate(component)], "class long, component long").union(spark.createDataFrame([(0, 0)], "class long, component long"))
    found = {tuple(sorted((r.a, r.b), reverse=True)) for r in near_dup.prefix_pairs(own, data, 0.8).collect()}
    assert len(expected) > 20 and expected <= found and all(component[i] != component[j] for i, j in found)


def test_a_bucket_of_unlinked_members_sends_no_pairs(spark):
    """20,000 sets that share 34 of 40 elements (similarity 34 / 46), each a component of its own, and one pair that is linked."""
    import numpy as np

    n, common = 20_000, 34
    rng = np.random.default_rng(1)
    shared = rng.integers(1 << 40, 1 << 41, common)

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                own = np.arange(40 - common) + 10 * min(i, n - 2)  # the last two have the same elements
                yield __import__("pandas").DataFrame({"class": [i], "component": [i], "set": [np.sort(np.concatenate([shared, own])).astype("<u8").tobytes()]})

    sets = spark.range(n).repartition(4).mapInPandas(run, "class long, component long, set binary").cache()
    rows = near_dup.prefix_rows(sets, 0.8)
    assert rows.count() == 9 * n and rows.where("indexed").count() == 5 * n
    assert [tuple(r) for r in near_dup.prefix_pairs(sets.select("class", "component"), sets.select("class", "set"), 0.8).collect()] == [(n - 2, n - 1, 1)]
    sets.unpersist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 300)]
    found = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}


def test_register_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        k = round(n * 2 * j / (1 + j))
        shared = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, n - k, dtype=np.uint64)])) for _ in "ab")
        x, y = near_dup.registers(a), near_dup.registers(b)
        assert abs(near_dup.likelihood_estimate(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0] - j) < 0.12
        assert (np.maximum(x, y) == near_dup.registers(np.union1d(a, b))).all()


# url filters


def brute_judge(rows, rules=url_filter.RULES):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        own = re.match(r"[^/?#]*", rest)[0]
        return own.translate(LOWER), re.match(r"[^?#]*", rest[len(own) :])[0]

    def decide(host, path):
        fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    parsed = [(i, *split(u), *decide(*split(u)), html) for i, u, html in rows]
    pages, by = Counter(), {"allow": Counter(), "block": Counter()}
    edges = Counter()
    for _, host, _, _, action, html in parsed:
        if host:
            pages[host] += 1
            if action:
                by[action][host] += 1
            for target in re.findall(url_filter.LINK, html or ""):
                if (target := target.translate(LOWER)) != host:
                    edges[host, target] += 1
    ranks = {}
    for action in by:
        seeds = [h for h in pages if by[action][h] > pages[h] / 2]
        own = edges if action == "allow" else Counter({(b, a): n for (a, b), n in edges.items()})
        total = Counter()
        for (a, _), n in own.items():
            total[a] += n
        start = {h: 1 / len(seeds) for h in seeds}
        rank = dict(start)
        for _ in range(300 if edges else 0):
            new = defaultdict(float, {h: (1 - url_filter.DAMPING) * x for h, x in start.items()})
            for (a, b), n in own.items():
                new[b] += url_filter.DAMPING * rank.get(a, 0) * n / total[a]
            rank = new
        ranks[action] = rank
    out = []
    for i, host, path, rule, action, _ in parsed:
        if action is None:
            bad = ranks["block"].get(host, 0) > url_filter.MARGIN * ranks["allow"].get(host, 0) and by["allow"][host] <= pages[host] / 2
            action = "block" if host and bad else "allow"
        out.append((i, host, path, rule, action))
    return sorted(out, key=str)


def test_url_filter(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a> <a href="/local">y</a>' for h in hosts)
    rows = [
        (1, "https://good.org/fr/1", link("friend.com", "FRIEND.com", "other.com")),
        (2, "https://good.org/fr/2?x=/de/", link("friend.com")),
        (3, "http://Bad.NET/a#b", link("farm.com")),
        (4, "https://farm.com/en/1", link("bad.net", "good.org")),
        (5, "https://farm2.com/", link("farm.com") + "<A HREF = '//bad.net?q'>"),
        (6, "https://friend.com", None),
        (7, "https://other.com/p?q#r", link("friend.com")),
        (8, "https://sub.example.net/en/x", ""),
        (9, "https://example.net/enx", ""),
        (10, "https://myexample.com/de/1", ""),
        (11, "https://a.example.com/de/1", link("myexample.com")),
        (12, None, link("bad.net")),
        (13, "no scheme/", "x"),
        (14, "://", "x"),
        (15, "ftp://net", "x"),
        (16, "https://net/", "x"),
        (None, "https://farm.com/en/1", link("bad.net")),
        (4, "https://farm.com/en/1", link("bad.net")),
        (17, "https://h.com/x\ny?z", "x"),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string").repartition(3)
    found = sorted((tuple(r) for r in url_filter.judge(pages).collect()), key=str)
    assert found == brute_judge(rows)
    assert ("farm2.com", "block") in {(r[1], r[4]) for r in found} and ("friend.com", "allow") in {(r[1], r[4]) for r in found}
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert found == sql_verdicts(rows)


def sql_verdicts(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(con.execute(ORACLES["op7_url_filter"]).fetchall(), key=str)


def test_distrust_reaches_far_and_settles(spark):
    link = lambda *hosts: "".join(f'<a href="//{h}/x">' for h in hosts)
    chain = [(i, f"http://c{i}.com/", link(f"c{i + 1}.com" if i < 30 else "bad.net")) for i in range(1, 31)]
    # a ring whose distrust goes round and a pair that lean to either side
    ring = [(40, "http://bad.net/", link("r1.com")), (41, "http://r1.com/", link("r2.com")), (42, "http://r2.com/", link("r1.com", "bad.net"))]
    mixed = [(50, "http://good.org/fr/", link("m1.com", "m1.com", "m2.com")), (51, "http://m1.com/", link("bad.net", "m2.com")), (52, "http://m2.com/", link("m1.com", "r1.com")), (53, "http://far.com/", link("good.org")), (54, "http://plain.com/", link("good.org")[:9])]
    rows = [*chain, *ring, *mixed]
    found = sorted((tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert found == brute_judge(rows) == sql_verdicts(rows)
    assert ("c1.com", "block") in {(r[1], r[4]) for r in found} and ("plain.com", "allow") in {(r[1], r[4]) for r in found}


# WARC


def brute_warc(rows):
    payload = [(h or "").encode() for _, _, h in rows]
    first = {}
    for (i, _, _), p in zip(rows, payload, strict=True):
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for (i, _, _), p in zip(rows, payload, strict=True):
        again = len(p) >= 100 and p in first and i != first[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, archive", [(64, 1 << 30), (1000, 300), (32 << 10, 1 << 30)])
def test_warc_roundtrip(spark, monkeypatch, segment, archive):
    """Also with many small archives, several of them to a task."""
    monkeypatch.setattr(warc, "ARCHIVE", archive)
    page = "<p>é\r\n\r\n0\r\n WARC/1.1 page</p>" * 9
    rows = [(5, "http://a/", page), (3, "http://b/\nc", page), (9, None, page), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", page), (None, "v", "only null ids " * 20), (None, "v", "only null ids " * 20), (10, "u", "x" * 300_000), (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99), (3, "again", "other " * 40), (15, "u", "other " * 40)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n int, digest string").repartition(4)
    found = sorted((tuple(r) for r in warc.roundtrip(pages, segment).collect()), key=str)
    assert found == brute_warc(rows)
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{'é' * (i * 50)}</html>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", 256)
    found = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(manifest, f"file://{tmp_path}/w").collect()}
    assert found == {i: h for i, _, h in rows}
    (tmp_path / "w" / "lost-attempt.warc.gz").write_bytes(b"not an archive")
    assert warc.read_archives(manifest, f"file://{tmp_path}/w").count() == 30


def test_warc_faults():
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c"), (1, None, b"a")]
    assert warc.put_together(parts) == b"abc"
    for bad in ([(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (2, None, b"b")], [(1, None, b"a"), (1, 1, b"b")]):
        with pytest.raises(warc.MalformedRecord):
            warc.put_together(bad)
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(warc.MalformedRecord):
            warc.unchunked(bad)
    data = b"".join(warc.page_records("n", 7, "u", b"p" * 500, "d", None, 100))
    kinds = [f["warc-type"] for f, _ in warc.records(data)]
    assert kinds[0] == "response" and set(kinds[1:]) == {"continuation"}
    with pytest.raises(warc.MalformedRecord):
        list(warc.records(data[:-3]))


def test_materialized_tables_are_in_the_shared_folder(spark):
    from vectide.llm.common import materialize

    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0].replace("file:///", "file:///") and df.count() == 5
