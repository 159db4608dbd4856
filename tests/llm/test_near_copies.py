"""Near copies against brute force over all pairs."""

import numpy as np

from lodestrand.llm import near_copies, simhash


def shingles(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def planted(rng, size, target):
    """A text and a copy of it in which single words change until the similarity is at most the target."""
    words = rng.choice([f"w{i}" for i in range(5000)], size).tolist()
    copy, own = list(words), shingles(" ".join(words))
    for n, at in enumerate(rng.permutation(size).tolist()):
        if jaccard(own, shingles(" ".join(copy))) <= target:
            break
        copy[at] = f"changed{n}"
    return [" ".join(words), " ".join(copy)]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.deduplicate(docs).collect()}


def test_planted_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [t for target in np.arange(0.70, 0.96, 0.01) for size in (60, 300) for _ in range(3) for t in planted(rng, size, target)]
    exact = " ".join(f"e{i}" for i in range(13))  # 9 shingles, of which a copy with one word more at the end has 9 of 10; with two, 9 of 11
    texts += [exact, exact + " x", exact + " y z", "", " ", "one", "One  ", "one two"]
    texts += [" ".join(f"f{i}" for i in range(8)), " ".join(f"f{i}" for i in range(9))]  # 4 of 5 shingles: exactly 0.8
    expected = kept_by_brute_force(texts)
    assert 0.4 * len(texts) < len(expected) < 0.9 * len(texts)
    assert kept(spark, texts) == expected


def test_groups_and_common_passages_against_brute_force(spark):
    """A large group of copies of one text, each changed in other places, and texts that share a passage without being near copies."""
    rng = np.random.default_rng(6)
    base, line = [f"b{i}" for i in range(120)], [f"c{i}" for i in range(30)]
    texts = []
    for i in range(150):
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)).tolist():
            copy[at] = f"v{i}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(line + [f"u{i}x{j}" for j in range(int(rng.integers(2, 20)))]) for i in range(150)]
    expected = kept_by_brute_force(texts)
    assert kept(spark, texts) == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stars = near_copies.similar_groups(docs, direct=4).groupBy("component").agg({"doc_id": "min"}).collect()
    assert {r["min(doc_id)"] for r in stars} == expected


def test_rows_of_one_document(spark):
    """Repeated rows stay once; unlike texts of one doc_id all stay; without a doc_id a row stays only if no other of its group is there."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "w"), (1, b, "y"), (2, a, "z"), (None, b, "n"), (None, "one of its own", "n"), (None, "one of its own", "m"), (3, None, "e"), (4, "", "e")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _n string"))
    assert kept.columns == ["doc_id", "text", "_n"]
    assert sorted(kept.collect(), key=repr) == sorted([(1, a, "w"), (1, b, "y"), (None, "one of its own", "m"), (3, None, "e")], key=repr)


def test_prefixes_rule_out_no_pair_that_has_the_similarity():
    rng = np.random.default_rng(11)
    kept = {True: 0, False: 0}
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        base = rng.choice(2**40, n + 40, replace=False).astype(np.uint64)
        a, b = base[:n], np.concatenate([base[: int(n * rng.uniform(0.3, 1))], base[n : n + int(rng.integers(0, max(1, n // 4) + 1))]])
        if not len(b):
            continue
        known = np.sort(rng.choice(base, int(rng.integers(0, 30)), replace=False))

        def prefix(x):
            x = x[np.lexsort((x, np.isin(x, known)))]
            return x[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1]

        shared = len(np.intersect1d(a, b))
        near = shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9
        may = near_copies.reachable(prefix(a), prefix(b), len(a), len(b), known, 0.8)
        assert may or not near
        kept[bool(near)] += may
    assert kept[True] > 300 and kept[False] < 1200


def test_fingerprints_link_first(spark, monkeypatch):
    """Without prefixes, texts are grouped as SimHash fingerprints link them; a link of texts that are no near copies isn't one."""
    rng = np.random.default_rng(8)
    texts = []
    for b in range(25):
        words = [f"b{b}w{i}" for i in range(int(rng.integers(80, 300)))]
        texts += [" ".join(words)] + [" ".join([*words[:-1], f"end{i}"]) for i in range(3)]
    texts += ["x x x x x", "x x x x x x x x y"]  # one fingerprint, and one of two shingles is shared
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_print = {}
    for r in simhash.near_duplicates(docs, words=5, most=3).collect():
        by_print.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {100, 101} in by_print.values() and 26 < len(by_print) < 90
    expected = sorted(sorted(x) for x in by_print.values() if x != {100, 101}) + [[100], [101]]
    made = near_copies._bucket_rows
    monkeypatch.setattr(near_copies, "_bucket_rows", lambda nodes: made(nodes).limit(0))
    found = {}
    for r in near_copies.similar_groups(docs).collect():
        found.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(sorted(x) for x in found.values()) == expected


def test_small_buckets_wait_while_large_ones_meet_more_centres(spark, monkeypatch):
    """Texts that share a passage and no more: one large bucket for its shingles, and many of three. The latter are joined with their roots once, not once a round."""
    texts = [" ".join([f"c{j}" for j in range(12)] + [f"u{i}x{j}" for j in range(2)]) + f" o{i}" for i in range(40)]
    texts += [" ".join([f"k{i // 3}x{j}" for j in range(8)] + [f"s{i}x{j}" for j in range(40)]) for i in range(90)]
    docs, seen, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], near_copies._open

    def watched(rows):
        seen.append(rows.count())
        return made(rows)

    monkeypatch.setattr(near_copies, "_open", watched)
    monkeypatch.setattr(near_copies, "_frequent", lambda docs, words, share: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    groups = {}
    for r in near_copies.similar_groups(docs, direct=5).collect():
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    assert {min(x) for x in groups.values()} == kept_by_brute_force(texts)
    assert len(seen) >= 4 and sum(seen[2:]) < seen[1] * (len(seen) - 2) * 0.8, seen
    assert all(x < 0.8 * seen[1] for x in seen[2:]), seen


def test_few_ends_are_sent_to_the_tasks(spark, monkeypatch):
    """Ends of pairs, few or many, give the same groups."""
    rng = np.random.default_rng(9)
    texts = [t for target in (0.75, 0.85) for _ in range(6) for t in planted(rng, 80, target)]
    expected = kept(spark, texts)
    assert expected == kept_by_brute_force(texts)
    monkeypatch.setattr(near_copies, "FEW", 1)
    assert kept(spark, texts) == expected


def test_what_near_dedup_leaves_in_the_shared_folder(spark, monkeypatch):
    """Prefixes, sets and buckets go when the groups are known."""
    made, tables = near_copies.staged, []

    def watched(df):
        tables.append(made(df))
        return tables[-1]

    monkeypatch.setattr(near_copies, "staged", watched)
    rng = np.random.default_rng(10)
    kept(spark, [t for target in (0.75, 0.85) for _ in range(6) for t in planted(rng, 80, target)])
    path = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    left = [df.columns for df in tables if path(df).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path(df))]
    assert len(tables) > 8 and left == [["fingerprint", "first", "size"]], left
