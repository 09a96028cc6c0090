"""URL cascades, conversation tries and filter interactions on small tables with odd rows."""

import hashlib
import zlib
from itertools import combinations, permutations

import numpy as np
import pytest
from oracle import connect, rows

from fairway.llm import common, interactions, turntrie, urls

SF = "/root/testdata/sf0.001"


# ---- URL filters ------------------------------------------------------------------------------------------------


def fitting(url, rules):
    """Brute force: host, path, rule and verdict of a url."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


ODD_URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "x://É.Net/É?q://y", "http://example.net/en", "http://example.net/en/", "http://xexample.net/en/", "http://a.b.example.com/de/x#f",
            "http://example.com:80/de/", "http://u@example.org/fr/", "http://org/fr/", "http://.net/", "http://net./", "//a.net/", "http://a.net?x/", "http://a\n.net/\nx", "a://b://c.net/", "http://net/" + "y" * 100_000]


def test_urls_against_brute_force(spark):
    given = [(i, u, "x", None) for i, u in enumerate(ODD_URLS)] + [(5, ODD_URLS[5], "x", None), (None, "http://a.net/", "x", None)]
    pages = spark.createDataFrame(given, "page_id long, url string, host string, keys string")
    got = urls.judge(pages)
    assert got.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"]
    want = [(i, *fitting(u, urls.RULES)) for i, u, *_ in given]
    assert sorted(map(repr, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()])) == sorted(map(repr, want))
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_long_lists_in_several_parts_are_exact(spark):
    """Thousands of rules in filters of a few hundred bytes, over urls of which most give keys that are not listed."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefghij"), 3)) for _ in range(900)]
    rules = [(("block", "allow")[i % 3 == 0], f"{n}.{('com', 'org')[i % 2]}", ("/", "/a", "/a/b/")[i % 3]) for i, n in enumerate(names)]
    rules += [("block", "org", "/a/b/c"), ("allow", None, "/"), ("other", "com", "/"), *rules[:5]]
    given = [(i, f"http://{'x.' * int(rng.integers(3))}{'abcdefghij'[i % 10]}{names[int(rng.integers(900))][1:]}.{('com', 'org')[int(rng.integers(2))]}{('', '/', '/a', '/a/b/c')[int(rng.integers(4))]}") for i in range(3000)]
    count = {}
    for v, h, p in rules:  # of a key both blocked and allowed, block stands
        if h and v != "other":
            count[h, p] = max(v, count.get((h, p), ""))
    kept = [(v, h, p) for (h, p), v in count.items()]
    got = urls.judge(spark.createDataFrame(given, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"), part_bytes=600)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == sorted(((i, *fitting(u, kept)) for i, u in given), key=lambda r: r[0])


def test_cascades_are_exact_and_hold_few_bits(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS a", "xxhash64(1, id) AS b", "id % 20 = 0 AS listed")
    cascade = urls.build(keys, "listed")
    table = keys.toPandas()
    assert (cascade.listed(table.a.to_numpy(), table.b.to_numpy()) == table.listed).all()
    assert len(cascade.levels) > 2 and 8 * sum(bits for bits, *_ in cascade.levels) < 20_000 * 64  # far from the keys themselves
    assert urls.build(keys.where("not listed"), "listed").levels == []


# ---- conversation tries -----------------------------------------------------------------------------------------


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {k: {m for m in members if len(m) == len(k) + 1 and m[: len(k)] == k} for k in members}
    out = []
    for k, ms in members.items():
        below = [m for m in members if m[: len(k)] == k]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(k))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(kids[k]), sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 3, 20_000])
def test_tries_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(c, None if turn == 0 and c % 7 == 0 else turn, ("user", None, "bot")[turn % 3], None if rng.random() < 0.1 else "éab"[: int(rng.integers(1, 4))] * int(rng.integers(1, 3)))
            for c in range(90) for turn in range(int(rng.integers(1, 9)))]
    rows += [(200 + i, t, "user", f"same {t}") for i in range(0, 40, 5) for t in range(6)] + [(300, t, "r", "deep") for t in range(300)] + [(None, 1, "user", "x"), (403, 5, "", "")]
    got = turntrie.trie(turntrie.rebuilt(conversations(spark, rows)), shard)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_tries_of_empty_tables_and_shared_starts_of_any_depth(spark):
    assert turntrie.trie(turntrie.rebuilt(conversations(spark, []))).count() == 0
    # All share 37 turns, then part: with few sequences a shard every shared start is merged over tasks.
    rows = [(5 * i, t, "u", f"t{t}" if t < 37 else f"{i} {t}") for i in range(30) for t in range(40)]
    got = turntrie.trie(turntrie.rebuilt(conversations(spark, rows)), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_double_arrays_find_what_they_hold_and_nothing_else():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 7, 400)
    codes = rng.integers(0, 30, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    trie = turntrie.DoubleArray(codes, begins, sizes)
    held = {tuple(codes[b : b + d]) for b, s in zip(begins, sizes) for d in range(s + 1)}
    assert (trie.check >= 0).sum() == len(held) and len(trie.check) < 3 * len(held)
    for _ in range(2000):
        word, cell = tuple(int(x) for x in rng.integers(0, 30, rng.integers(1, 4))), np.array([0])
        for c in word:
            cell = trie.step(cell, np.array([c])) if cell[0] >= 0 else cell
        assert (cell[0] >= 0) == (word in held)


def test_small_shards_give_the_rows_of_the_sql(spark):
    got = turntrie.trie(turntrie.rebuilt(common.table(spark, SF, "conversations")), 5)
    result = connect(SF).execute(turntrie.ORACLE)
    names = [d[0] for d in result.description]
    assert rows(got.columns, got.collect()) == rows(names, result.fetchall())


# ---- filter interactions ----------------------------------------------------------------------------------------


def test_states_of_the_walk_are_the_survivors_of_each_set():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 50, (32, 3))
    states = interactions.survivors(cells, 5)
    for active in range(32):
        assert (states[active] == cells[[m for m in range(32) if not m & active]].sum(axis=0)).all()


def brute_steps(docs, labels):
    """Every order applied to every document one by one."""
    ids = [d[0] for d in docs]
    out = {}
    fails = []
    for i, (doc, text, lang) in enumerate(docs):
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        fails.append({k for k, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
                     doc is not None and any(ids[j] is not None and ids[j] < doc and (docs[j][1] or "") == text for j in range(len(docs))))) if bad})
    good = lambda i, k: any(d is not None and d == ids[i] and (q, t)[k] == 1 for d, q, t in labels)
    for part in {d[2] or "" for d in docs}:
        mine = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order):
                gone = [i for i in left if f in fails[i]]
                total[f] += len(gone)
                redundant = sum(f in fails[i] for i in mine) - len(gone)
                left = [i for i in left if f not in fails[i]]
                out[part, order, step + 1] = (f, len(left), len(gone), redundant, sum(fails[i] == {f} for i in mine), sum(good(i, 0) for i in gone), sum(good(i, 1) for i in gone))
        out |= {k: (*v[1:], total[v[0]]) for k, v in out.items() if k[0] == part}
    return sorted((*k, *v) for k, v in out.items())


def test_interactions_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\n", "a b", "A b", "a#b", long, long + " #", long.upper(), "x " * 300, "x\x0by " * 300, "\u00a0" * 5, "ÄÖ", long]
    docs = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(texts * 3)] + [(None, long, "en"), (6, long, "en"), (6, long, "fr"), (6, "other", "en")]
    labels = [(0, 1, 0), (1, None, 1), (3, 0, 1), (3, 1, 0), (None, 1, 1), (6, 1, 1), (17, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(d, t, x, "clash", True) for d, t, x in docs], "doc_id long, text string, lang string, mask string, first boolean")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(table, known)
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(order).collect())) == brute_steps(docs, labels)
    assert interactions.audit(table.limit(0), known).count() == 0
    assert got.count() == 600 * 4 and got.groupBy("part", "filter_order").sum("removed").where("`sum(removed)` < 0").count() == 0


def test_shares_of_all_orders_add_up():
    """Shapley: what the filters remove together is split among them, whatever the order."""
    cells = np.arange(32)[:, None] * np.ones((1, 3), np.int64)
    states = interactions.survivors(cells.astype(np.int64), 5)
    table = interactions.steps(states).drop_duplicates(["shapley", "unique_fails"])
    removed = states[0][0] - states[31][0]
    assert interactions.steps(states).groupby("filter_order").removed.sum().eq(removed).all()
    assert len(list(combinations(range(5), 2))) == 10 and table.shapley.sum() == 120 * removed
