"""Token coding, fingerprints, passages, classifiers and mixing on small tables with odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fairway.llm import bpe, common, linear, mixing, quality, simhash, substring, toxicity
from fairway.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, token_ids string, spans_ int, quality_score_ int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, 2) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "naïve ÄÖ 漢字 🙂 <|endoftext|> don't  stop\r\n\n1234"), (6, "long " * 60_000)]


def test_bpe_matches_the_library_and_round_trips(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = bpe.decode(bpe.encode(docs(spark, ODD))).select("text", "token_ids", "decoded").collect()
    assert len(got) == len(ODD)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_takes_ids_that_are_none_and_empty_tables(spark):
    rows = spark.createDataFrame([([72, None, -1, 10**6, 50256],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(rows).collect()] == ["i<|endoftext|>", "", ""]
    assert bpe.digests(docs(spark, [])).count() == 0


def brute_fingerprint(text, k):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 60)) for _ in range(12)]
    rows = ODD + [(10 + i, t) for i, t in enumerate(base)] + [(40 + i, t[:-1] + "q") for i, t in enumerate(base)] + [(90 + i, base[0]) for i in range(30)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [(i, brute_fingerprint(t, 4)) for i, t in rows]
    known = sorted({(i, p) for i, p in prints if i is not None})
    up = {i: i for i, _ in known}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in known:
        for j, q in known:
            if (p ^ q).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = sorted((str(i), f"{p:016x}", str(find(i) if i is not None else None)) for i, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_crowded_keys_lose_no_link():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 6, 400).astype(np.int64) << 20
    a, b = simhash._forest(np.zeros(400, np.int64), fp, np.arange(400), 1)
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a, b):
        assert int(fp[x] ^ fp[y]).bit_count() <= 1
        up[find(x)] = find(y)
    for x in range(400):
        for y in range(x):
            assert int(fp[x] ^ fp[y]).bit_count() > 1 or find(x) == find(y)


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_keep_one_keeps_rows_without_id_and_one_of_each_group(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "k l m n o p"), (3, "k l m n o p"), (None, "a b c d e")]
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs(spark, rows)).collect())
    assert kept == ["1", "3", "None"]


def test_near_dedup_stage_keeps_one_of_each_group_at_the_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    rows = [(900 + k, t) for k, (_, t) in enumerate(ODD[:3])]
    for g in range(12):
        base = words(rng, 150)
        for k in range(6):
            copy = base.copy()
            for at in rng.choice(150, k if g % 2 else 2, replace=False):
                copy[at] = f"z{g}y{k}x{at}"
            rows.append((10 * g + k, " ".join(copy)))
    sets = {i: set(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    want = {i for i in sets if find(i) == i}
    assert len(want) < len(rows) - 20
    got = corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("part", [3, 2048])
def test_near_dedup_links_of_a_group_are_a_forest(spark, monkeypatch, part):
    """Many texts that share keys, of which few are similar: as many links as connect them, however the group is cut."""
    from fairway.llm import neardup

    rng, rows = np.random.default_rng(21), []
    common_, tails = words(rng, 90), [words(rng, 60) for _ in range(20)]
    for i in range(80):
        text = common_ + tails[i % 20]
        text[int(rng.integers(100, 150))] = f"x{i}"
        rows.append((i, " ".join(text)))
    sets = [neardup.shingle_set(t.encode()) for _, t in rows]
    labels = np.arange(80)
    links = neardup.forest(labels.copy(), sets)
    up = labels.copy()
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[up == up[i]] = up[j]
    assert len(links) == 80 - len(set(up.tolist())) and all(up[i] == up[j] for i, j in links)
    assert neardup.forest(up, sets) == []
    monkeypatch.setattr(neardup, "PART", part)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: min(j for j in range(80) if up[j] == up[i]) for i in range(80)}


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_compact_windows_cover_every_passage_once():
    h = np.random.default_rng(3).integers(0, 50, 40).astype(np.uint64)
    windows = substring.compact_windows(h, 7)
    for i in range(40):
        for j in range(i + 7, 41):
            least = i + int(h[i:j].argmin())
            assert [w for w in windows if w[0] <= i <= w[1] < j <= w[2]] == [w for w in windows if w[1] == least and w[0] <= i and j <= w[2]]
            assert sum(w[0] <= i and w[1] == least and j <= w[2] for w in windows) == 1


def test_growth_and_scattered_windows_are_those_of_plain_loops():
    rng = np.random.default_rng(17)
    for n in (0, 1, 63, 64, 65, 320, 2000):
        for share in (0.05, 0.2, 0.3):
            x = rng.integers(0, 1 << 60, n).astype(np.uint64)
            y = np.where(rng.random(n) < share, x + np.uint64(1), x)
            score, best, at = 0, 0, 0
            for k in range(n):
                score += 1 if x[k] == y[k] else -4
                if score > best:
                    best, at = score, k + 1
                if best - score > 8 * substring.SHINGLE:
                    break
            assert substring._grown(x, y) == at
    n, found = substring.LEAST, 0
    for trial in range(30):
        x = rng.integers(0, 1 << 60, 300).astype(np.uint64)
        y = np.concatenate((x[100:140], rng.integers(0, 1 << 60, trial % 8).astype(np.uint64), x[140:200]))
        if trial % 3 == 0:
            y[5:9] = y[4]
        a, b = 120, 25
        at_b, at_a = 0, max(a - 2 * n - substring.BAND, 0)
        own, near, want, done = y[: b + 2 * n], x[at_a : a + 2 * n + substring.BAND], [], -1
        for q in range(len(own) - n + 1):
            mine = own[q : q + n]
            if q < done or np.isin(mine, near).sum() < substring.SHARED:
                continue
            both = [int(np.isin(near[p : p + n], mine).sum()) for p in range(len(near) - n + 1)]
            p = min((p for p, k in enumerate(both) if k == max(both)), key=lambda p: abs(p + at_a - a - q - at_b + b))
            u, v = set(near[p : p + n].tolist()), set(mine.tolist())
            if len(u & v) / len(u | v) >= substring.SIMILARITY:
                want.append((at_a + p, at_a + p + substring.WORDS, at_b + q, at_b + q + substring.WORDS, len(u & v) / len(u | v)))
                done = q + n // 4
        assert substring._scattered(x, y, a, b, []) == want
        found += len(want)
    assert found > 30


def test_every_repeated_exact_passage_is_found_and_clean_texts_are_left_alone(spark):
    rng = np.random.default_rng(4)
    shared = [words(rng, n) for n in (51, 80, 200)]
    rows = [(i, " ".join(words(rng, 40) + shared[i % 3] + words(rng, 30))) for i in range(30)]
    rows += [(100 + i, " ".join(words(rng, 150))) for i in range(10)] + [(200, rows[0][1]), (201, None), (202, ""), (None, rows[0][1])]
    found = substring.repeated_passages(docs(spark, rows)).collect()
    covered = {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.source_id < r.doc_id and r.similarity >= 0.8
    for i in range(3, 30):
        assert covered[i] >= set(range(40, 40 + len(shared[i % 3])))
    assert covered[200] == set(range(len(rows[0][1].split()))) and not {0, 1, 2, *range(100, 110)} & set(covered)
    cut = {r.doc_id: r.text for r in substring.cut_repeats(docs(spark, rows)).collect()}
    assert cut[100] == dict(rows)[100] and 200 not in cut and not set(shared[0]) & set(cut[3].split()) and cut[202] == ""


def test_edited_passages_are_found(spark):
    rng = np.random.default_rng(5)
    a = words(rng, 300)
    b = a.copy()
    b[60], b[200] = "x", "y"
    got = substring.repeated_passages(docs(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    assert sum(r.end_word - r.start_word for r in got) >= 280


def repeated_windows(texts):
    """(doc, place) of every window of WORDS words that is similar to one of a smaller document, and how many shingles they share, by comparing all."""
    base = {i: substring.shingles(t.encode()) for i, t in texts}
    n, found = substring.LEAST, {}
    for b, y in base.items():
        for a, x in base.items():
            if a >= b or len(x) < n or len(y) < n:
                continue
            for k in range(len(y) - n + 1):
                held = np.concatenate(([0], np.cumsum(np.isin(x, y[k : k + n]))))
                both = int((held[n:] - held[:-n]).max())
                if both >= substring.SHARED:  # both have n different shingles
                    found[b, k] = max(both, found.get((b, k), 0))
    return found


def uncovered(spark, rows):
    want = repeated_windows(rows)
    covered = {i: np.zeros(len(t.split()) + 1) for i, t in rows}
    for r in substring.repeated_passages(docs(spark, rows)).collect():
        covered[r.doc_id][r.start_word : r.end_word] = 1
        assert r.source_id < r.doc_id and r.similarity >= 0.8
    return want, {(b, k) for b, k in want if covered[b][k : k + substring.WORDS].mean() < substring.COVERED}


@pytest.mark.parametrize("n, edits, part", [(60, 1, 1024), (100, 2, 4), (100, 5, 1024), (200, 6, 3)])
def test_groups_of_near_copies_leave_no_window_uncovered(spark, monkeypatch, n, edits, part):
    monkeypatch.setattr(substring, "PART", part)
    rng = np.random.default_rng(n + edits)
    passage, rows = words(rng, n), []
    for i in range(24):
        copy = passage.copy()
        for k in rng.choice(n, edits, replace=False):
            copy[k] = [f"x{i}y{k}", f"{copy[k]} z{i}", ""][int(rng.integers(3))]  # another word, one more, one less
        rows.append((i, " ".join(" ".join(words(rng, 40) + copy + words(rng, 40)).split())))
    want, missed = uncovered(spark, rows)
    assert len(want) > 30 and not missed


def test_mosaics_of_common_lines_leave_no_window_uncovered(spark):
    """Texts of lines that all occur elsewhere; only some neighbours are the same, and not those of the smallest document."""
    rng = np.random.default_rng(31)
    lines = [words(rng, 20) for _ in range(12)]
    rows = [(i, " ".join(sum((lines[k] for k in rng.permutation(12)[:8]), []))) for i in range(40)]
    want, missed = uncovered(spark, rows)
    assert want and len(missed) <= 0.01 * len(want)


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    rng = np.random.default_rng(8)
    passage = words(rng, 80)
    for n in (50, 200):
        rows = []
        for i in range(n):
            copy = passage.copy()
            copy[int(rng.integers(80))] = f"x{i}"
            rows.append((i, " ".join(words(rng, 20) + copy + words(rng, 20))))
        assert substring.repeated_passages(docs(spark, rows)).count() < 12 * n


def test_passages_of_odd_tables(spark):
    rng = np.random.default_rng(9)
    a, b = words(rng, 120), words(rng, 120)
    text = {"a": " ".join(a), "b": " ".join(b), "c": " ".join(a[:60] + b[60:])}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["a"]), (2, text["c"]), (3, text["b"]), (3, text["b"]), (4, None), (None, text["a"]), (5, "x y " * 4000), (6, "x y " * 3000), (7, " ".join(a) + " ".join(b) * 200)]
    got = substring.repeated_passages(docs(spark, rows)).collect()
    assert all(r.source_id < r.doc_id for r in got) and {4} & {r.doc_id for r in got} == set()
    kept = substring.cut_repeats(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    back = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(i == 3 for i, _ in back) <= 1 and (None, text["a"]) in back and (4, None) in back
    assert sorted(map(str, back)) == sorted(str((r.doc_id, r.text)) for r in substring.cut_repeats(docs(spark, rows[::-1])).collect())


def test_large_groups_of_equal_windows_are_covered(spark):
    rng = np.random.default_rng(12)
    passage = words(rng, 60)
    heads, tails = [words(rng, 70) for _ in range(4)], [words(rng, 70) for _ in range(4)]
    rows = [(i, " ".join(heads[i % 4] + passage + tails[i // 4 % 4] + passage)) for i in range(16)] + [(20 + i, " ".join(words(rng, 30) + passage)) for i in range(10)]
    covered = {}
    for r in substring.repeated_passages(docs(spark, rows)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i in range(1, 16):
        assert covered[i] >= {*range(70, 130), *range(200, 260)}
    assert all(covered[20 + i] >= set(range(30, 90)) for i in range(10))


def test_passages_of_an_empty_table(spark):
    assert substring.repeated_passages(docs(spark, [])).count() == 0
    assert substring.cut_repeats(docs(spark, [])).count() == 0


def test_dual_descent_separates_and_calibrates():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5))
    y = np.where(x @ [1, -2, 0, 0.5, 0] > 0.2, 1.0, -1.0)
    w = linear.dual_descent([(np.arange(5), r) for r in x], y, 5, np.full(300, 10.0), epochs=200)
    m = x @ w[:-1] + w[-1]
    assert (np.sign(m) == y).mean() > 0.97
    slope, offset = linear.calibrate(m, y)
    assert slope > 0 and ((linear.sigmoid(slope * m + offset) > 0.5) == (y > 0)).mean() > 0.95


def labelled(spark, good, bad, column):
    rows = [(i, g, 1) for i, g in enumerate(good)] + [(1000 + i, b, 0) for i, b in enumerate(bad)]
    table = docs(spark, [(i, t) for i, t, _ in rows])
    return table, spark.createDataFrame([(i, v) for i, _, v in rows] + [(None, 1), (5000, None)], f"doc_id long, {column} int")


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(7)
    good = [" ".join(words(rng, 80)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 80)) for _ in range(75)] + [" ".join(w for x in words(rng, 20) for w in [x] * 5) for _ in range(75)]
    table, labels = labelled(spark, good, bad, "quality")
    scored = quality.score(table, quality.fit(table, labels)).select("doc_id", "quality_score", common.held_out(table.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r.h]
    assert np.mean([(r.quality_score >= 0.7) == (r.doc_id < 1000) for r in held]) > 0.95
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if r.quality_score >= 0.7}


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels_and_odd_texts(spark, module, column):
    empty = spark.createDataFrame([], f"doc_id long, {column} int")
    scored = module.score(docs(spark, ODD), module.fit(docs(spark, ODD), empty), out_col="score")
    assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
    assert module.score(docs(spark, []), module.fit(docs(spark, []), empty)).count() == 0


def brute_kernel(s, t, n, decay):
    """Sum over all pairs of equal subsequences of length n of decay ** (their spans)."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_string_kernel_against_brute_force():
    units = ["^idiot$", "^idxiot$", "abab", "xyz", "^a"]
    codes = toxicity._codes(units)
    got = toxicity.kernel(codes, codes)
    for i, s in enumerate(units):
        for j, t in enumerate(units):
            assert got[i, j] == pytest.approx(brute_kernel(s, t, toxicity.ORDER, toxicity.DECAY), rel=1e-4)


def test_toxicity_tolerates_gaps_and_inserted_letters(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnoprstuvwy"))
    word = lambda: "".join(rng.choice(letters, rng.integers(3, 9)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    toxic = [" ".join([word() for _ in range(30)] + [str(rng.choice(["idiot", "worthless"]))] + [word() for _ in range(30)]) for _ in range(200)]
    table, labels = labelled(spark, toxic, clean, "toxic")
    model = toxicity.Model.unpack(toxicity.fit(table, labels))
    probe = ["id-iot", "i d i o t", "idxiot", "worth less", "so worthxless", "a quiet day", ""]
    p = model.probability([f"{clean[0]} {t} {clean[1]}" for t in probe])
    assert (p[[0, 1, 2, 4]] >= 0.3).all() and (p[[5, 6]] < 0.3).all()


def brute_fill(weights, capacity, given):
    """Budgets by handing on what full children lack, step by step."""
    got, open_ = [0.0] * len(weights), set(range(len(weights)))
    while given > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if got[i] + given * weights[i] / total >= capacity[i]}
        if not full:
            for i in open_:
                got[i] += given * weights[i] / total
            break
        spent = sum(capacity[i] - got[i] for i in full)
        for i in full:
            got[i] = capacity[i]
        given -= spent
        open_ -= full
    return got


def test_budgets_are_filled_like_step_by_step(spark):
    rng = np.random.default_rng(9)
    weights, capacity = rng.uniform(0.1, 3, 8).tolist(), rng.uniform(1, 100, 8).tolist()
    given = sum(capacity) * 0.6
    df = spark.createDataFrame([(0, i, w, c, given) for i, (w, c) in enumerate(zip(weights, capacity))], "u int, k int, weight double, capacity double, given double")
    got = {r.k: r.budget for r in mixing._fill(df, ["u"], "k").collect()}
    # Shortages are shared in proportion to weight, so one level of water fills all that is open.
    level = max(got[i] / weights[i] for i in got)
    assert sum(got.values()) == pytest.approx(given) and all(got[i] == pytest.approx(min(capacity[i], level * weights[i])) for i in got)
    assert got == pytest.approx(dict(enumerate(brute_fill(weights, capacity, given))), rel=1e-6)


def test_mixing_repeats_short_leaves_and_takes_odd_rows(spark):
    rows = [(i, "w " * 10, "en" if i % 4 else "de", f"src{i % 3}") for i in range(200)] + [(None, "a b", None, None), (900, None, "en", "src0"), (901, "", "fr", "src1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(table, share=0.8, epochs=2)
    total = got.agg({"n_tokens_": "sum"}).first()[0]
    assert 0.6 * 2002 <= total <= 0.8 * 2002 and got.groupBy("doc_id", "epoch_").count().where("count > 1").count() == 0
    assert mixing.mixed_documents(table).columns == table.columns and mixing.mix(table.limit(0)).count() == 0
