"""op11 to op13 against brute force, with nulls, empty texts, ties, repeated
rows, empty tables and clashing column names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from tidemark.llm import hyperminhash as H  # noqa: E402
from tidemark.llm import prefix_trie as P  # noqa: E402
from tidemark.llm import spelling as S  # noqa: E402

EXTRA = "doc_id long, text string, id long, key long, n long, cls string, sketch string"


# --- op11 -------------------------------------------------------------------------------------------
def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i: i + 4]) for i in range(max(len(w) - 3, min(len(w), 1))))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(s), low[find(i)], d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("turns, block", [(3, 1024), (0, 7)])
def test_near_duplicates_against_all_pairs(spark, turns, block):
    rng, rows = random.Random(11), []
    for group, size in ((0, 25), (1, 12), (2, 3)):
        base = [f"g{group}w{i}" for i in range(60 + 40 * group)]
        for _ in range(size):  # from nearly equal to far apart
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b c d e f g h"), (906, "a b c d e f g h i"), (906, "A b c d e f g h"),
             (None, rows[3][1]), (907, "lonely words stand here"), (908, " ".join(f"w{i}" for i in range(20_000))), (909, " ".join(f"w{i}" for i in range(19_000)))]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "c", "s") for d, t in rows], EXTRA)
    classes = H.near_duplicates(docs, turns=turns, block=block)
    assert classes.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, classes.collect()), key=str) == brute_components(rows)


def test_near_copies_that_are_not_alike_make_few_pairs(spark, monkeypatch):
    rng, staged, pairs = random.Random(3), H.staged, []
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):  # from the base: 0 to 9 words, each in four shingles
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 10)):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))

    def counted(df, name):
        out = staged(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(H, "staged", counted)
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "c", "s") for d, t in rows], EXTRA)
    assert sorted(map(tuple, H.near_duplicates(docs).collect()), key=str) == brute_components(rows)
    assert sum(pairs) < 5 * len(rows)


def test_near_copies_that_share_changes_make_few_pairs(spark, monkeypatch):
    """Two of a family share most of their changes, so few shingles are in one text only."""
    rng, staged, pairs, rows = random.Random(4), H.staged, [], []
    base = [f"w{i}" for i in range(150)]
    for k in range(100):
        family = rng.sample(range(150), 3)
        for i in (2 * k, 2 * k + 1):
            w = list(base)
            for at in family:
                w[at] = f"x{k}y{at}"
            w[rng.randrange(150)] = f"z{i}"
            rows.append((i, " ".join(w)))

    def counted(df, name):
        out = staged(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(H, "staged", counted)
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "c", "s") for d, t in rows], EXTRA)
    assert sorted(map(tuple, H.near_duplicates(docs).collect()), key=str) == brute_components(rows)
    assert sum(pairs) < 5 * len(rows)


def test_parity_sketches_drop_no_alike_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64)) for n in (1, 30, 200, 250, 260, 2000, 2100, 30_000)]
    sets += [np.unique(np.concatenate([x[: int(len(x) * s)], rng.integers(1, 1 << 63, int(len(x) * t)).astype(np.uint64)])) for x in sets for s, t in ((1, 0.24), (0.9, 0.1), (0.85, 0.03), (0.6, 0.3))]
    n = np.array(list(map(len, sets)))
    known = H._Parities([None, *map(H.parity_sketch, sets)])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    alike = 100 * common >= 80 * (n[i] + n[j] - common)
    far = known.too_far(i + 1, j + 1, np.append(0, n))
    assert not (far & alike).any() and alike.sum() > len(sets)
    assert far[(n[i] < 3000) & (n[j] < 3000) & (100 * common < 60 * (n[i] + n[j] - common)) & (n[i] > 100) & (n[j] > 100)].all()
    assert not known.too_far(np.zeros(3, int), np.arange(3), np.append(0, n)).any()  # without a sketch nothing is known


def test_near_duplicates_of_an_empty_table(spark):
    assert H.near_duplicates(spark.createDataFrame([], EXTRA)).count() == 0


def test_register_estimate_is_near_the_true_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((5000, 4500), (400, 380), (3000, 1500)):
        pool = rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = H.registers([np.unique(pool[:n]), np.unique(pool[n - common:])])
        true = common / (2 * n - common)
        got = ((a == b) & (a != 0)).sum() / ((a | b) != 0).sum()
        assert abs(got - true) < 5 * (true * (1 - true) / 256) ** 0.5
        assert H.may_link(a[None], b[None], np.array([n]), np.array([n]))[0] == (true > 0.7)
        fa, fb = H.folded(a[None]), H.folded(b[None])
        assert H.may_link(fa, fb, np.array([n]), np.array([n]))[0] == (true > 0.7)


def test_bands_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for n in (5, 20, 300, 4000):
        for _ in range(40):
            cut = max(1, n // 10)
            pool = rng.integers(1, 2**63, n + cut, dtype=np.uint64)
            keys = H.band_keys(H.registers([np.unique(pool[:n]), np.unique(pool[cut:])]))
            assert n < 9 or ((keys[0] == keys[1]) & (keys[0] != 0)).any()  # (n - cut) / (n + cut) is 0.8 or more from 9 on


# --- op12 -------------------------------------------------------------------------------------------
def brute_trie(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    tie = lambda t: hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], tie(t)))] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in convs.items()}
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), sum(all(q[:len(b)] != b or q == b for q in below) for b in below),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONV = "conv_id long, turn long, role string, text string, node string, depth string"


def made_conversations():
    rng, rows = random.Random(12), []
    for c in range(0, 130):
        if c % 11 == 3:
            continue
        for t in range(rng.choice([1, 2, 2, 3, 6])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "a b", "a b c", ""]) if t < 2 else f"{rng.randrange(4)} x y"))
    rows += [(200, t, "user", "same") for t in range(3)] + [(c, t, "user", "same") for c in range(201, 219) for t in range(3)]
    rows += [(300, t, "bot", f"long {t}") for t in range(150)] + [(301, t, "bot", f"long {t}") for t in range(149)]
    rows += [(None, 1, "user", "lost"), (400, None, None, None), (400, 0, "user", None), (401, 2, "user", "b"), (401, 2, "user", "a"), (401, None, "user", "z"), (401, 2, "user", "a"),
             (402, 0, "u", "ser a"), (403, 0, "us", "er a"), (505, 0, "user", "only one")]
    return rows


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_prefix_trie_against_brute_force(spark, parts):
    rows = made_conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONV)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = P.prefix_trie(P.rebuilt(P.conversation_turns(df))).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_prefix_trie_without_rebuilding_and_of_nothing(spark):
    rows = made_conversations()[:120]
    turns = P.conversation_turns(spark.createDataFrame([(*r, "x", "y") for r in rows], CONV))
    assert sorted(map(tuple, P.prefix_trie(turns).select(COLUMNS).collect()), key=str) == brute_trie(rows, rebuild=False)
    assert P.prefix_trie(turns.limit(0)).count() == 0


def test_long_runs_of_ends_are_digested_in_chunks(spark):
    was, P.CHUNK_IDS = P.CHUNK_IDS, 3
    try:
        f = P.Forest(list(range(10)), [b"x" * 16] * 10, [[1]] * 10)
        chunks = [r for r in f.run() if r["kind"] == "ends"]
    finally:
        P.CHUNK_IDS = was
    assert b",".join(r["ids"] for r in chunks) == b"0,1,2,3,4,5,6,7,8,9" and len(chunks) == 4


# --- op13 -------------------------------------------------------------------------------------------
def brute_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(words):
    out, form = [], {}
    near = {w: [x for x in words if brute_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def made_words():
    rng, words = random.Random(13), {}
    for base in ("spelling", "aaaaaaa", "abababab", "éàçüöñß", "letterbox", "mississippi"):
        words[base] = 5000
        for _ in range(40):
            w, at = words and base, rng.randrange(len(base))
            for _ in range(rng.choice([1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abséß")
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at + 1:], w[:at] + c + w[at:]])
            words.setdefault(w, rng.choice([1, 2, 30, 400, 600]))
    for n, w in ((3, "z" * 48), (3, "z" * 49), (40, "z" * 50), (900, "y" + "z" * 48), (5, "q" * 700), (60, "q" * 350 + "x" + "q" * 349), (5, "q" * 350 + "xy" + "q" * 348)):
        words[w] = n
    words.update({"ab": 3, "abc": 50, "a": 2, "b": 900})
    return words


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0, "max_levels": 9}])
def test_spelling_groups_against_all_pairs(spark, options):
    words = made_words()
    df = spark.createDataFrame([(w, n, "x", "y", 1) for w, n in words.items()], "word string, n long, form string, node string, depth int")
    got = S.spelling_groups(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_spelling(words)
    assert S.spelling_groups(df.limit(0), **options).count() == 0


def test_word_counts(spark):
    rows = [(i, t) for i, t in enumerate(["Éclairs Spelling spelling, SPELLING-spelling x1spelling", None, "", "short word", "Spelling " * 40, "ÉCLAIRS éclairs Éclairs", "a" * 5000])]
    rows += [(None, "spelling spelling"), (4, "Spelling " * 40), *[(100 + i, "spelling correct letters") for i in range(60)]]
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(d, t, "x", 2) for d, t in rows], "doc_id long, text string, run string, h int")
    assert {r.word: r.n for r in S.word_counts(docs).collect()} == want and len(want) > 3
    assert S.word_counts(docs.limit(0)).count() == 0


def test_variant_hashes():
    for w in ("a", "spelling", "aab"):
        own, cut = S.variant_hashes(w)
        assert cut == {S.variant_hashes(w[:i] + w[i + 1:])[0] for i in range(len(w))} and own not in cut
    assert S.one_edit("ab", "ba") is False and S.one_edit("ab", "abc") and S.one_edit("xb", "ab") and not S.one_edit("a", "a")
