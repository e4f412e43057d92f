"""Prefix trie, vector codes and personal data against brute force: ties, nulls, empty and long input, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cleargrain.llm import pii, prefix_trie, vector_codes


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- 11 prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = (*own.get(c - int(np.fmod(c, 20)), [])[:h], *turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out, inner = set(), {p[:-1] for p in members if p}
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if p not in inner]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children), len(leaves), saved, digest))
    return out


def trie_rows():
    random.seed(7)
    rows = [(c, t, random.choice(["user", None, "bot"]), random.choice(["a b", "", None, "c"])) for c in [*range(-3, 70), 1000, 2**60 + 1] for t in range(random.randint(1, 6))]
    rows += [(80, t, "user", f"long {t}") for t in range(90)] + [(c, t, "user", f"long {t}") for c in (81, 95) for t in range(50)]  # a hot conversation and its kin
    rows += [(c, 0, "user", "copy of one") for c in range(120, 180)]
    rows += [(200, None, "user", "before the first"), (200, 0, "user", "first"), (None, 0, "user", "nobody's"), (41, 9, "user", "x"), (41, 9, "user", "x")]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [40, 20_000])
def test_trie_matches_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL_NODES", local)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    if local == 40:
        monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(prefix_trie, "SALTS", 3)
        monkeypatch.setattr(prefix_trie, "HOT_CHILDREN", 2)
    rows = trie_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS + ", depth string, a int").repartition(5)
    got = prefix_trie.prefix_trie(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r[n] for n in names) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], CONVERSATIONS)).count() == 0
    one = rows_of(prefix_trie.prefix_trie(spark.createDataFrame([(23, 0, "user", "x y")], CONVERSATIONS)))  # crc32("23") % 4 cuts its only turn
    assert {r["depth"] for r in one} == ({0} if zlib.crc32(b"23") % 4 else {0, 1}) and all(r["n_convs"] == 1 for r in one)


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_roll_up(shape):
    rng = np.random.default_rng(1)
    n = 400
    parent = np.array([-1, *{"random": [rng.integers(0, i) for i in range(1, n)], "chain": range(n - 1), "star": [0] * (n - 1)}[shape]])
    parent[n // 2] = -1  # two trees
    values, weight = rng.integers(0, 9, (n, 2)), rng.integers(1, 5, n)
    sums, heavy, depth = values.copy(), weight.copy(), np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            sums[parent[i]] += sums[i]
            heavy[parent[i]] += heavy[i]
    assert np.array_equal(prefix_trie.roll_up(parent, depth, heavy, values), sums)


# ---- 12 vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([np.floor(256 * np.array(r[1], dtype=np.float64)) for r in kept]).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = assign()
        for p, e in itertools.product(range(parts), range(books.shape[1])):
            own = x[code[:, p] == e, p]
            if len(own):
                books[p, e] = own.sum(axis=0) // len(own)
    code, error = assign()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = defaultdict(int)
    for r, e in zip(kept, error.sum(axis=1).tolist()):
        by_label[r[2]] += e
    return sorted(((r[0], bytes(c.astype(np.uint8)).hex(), int(e), by_label[r[2]], digest) for r, c, e in zip(kept, code, error.sum(axis=1))), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, row int"


@pytest.mark.parametrize("broadcast_labels", [0, 100_000])
@pytest.mark.parametrize("coarse", [False, True])
def test_codes_match_brute_force(spark, monkeypatch, coarse, broadcast_labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", broadcast_labels)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 16)) + 3 * rng.integers(0, 3, (700, 1))
    x = np.round(x) / 64 if coarse else x  # ties everywhere
    rows = [(i, [float(v) for v in x[i]], int(i % 5) if i % 7 else None) for i in range(700)]
    rows += [(5_000 + i, rows[3][1], 1) for i in range(200)] + [(6_000, None, 1), (6_001, [float("nan")] * 16, 1), (6_002, [None] * 16, 2), (6_003, [float("inf")] * 16, 2), (None, rows[9][1], 0), (10**6, [-0.001] * 16, 0)]
    df = spark.createDataFrame([(*r, "c", 7) for r in rows], VECTORS).repartition(4)
    got = vector_codes.compress_vectors(df, parts=4, entries=32, rounds=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 4, 32, 5)


def test_bounds_are_true_bounds():
    rng = np.random.default_rng(2)
    x, books = rng.integers(-500, 500, (400, 4)), rng.integers(-500, 500, (64, 4))
    near, up, low = vector_codes.closest(x, books, 16)
    full = 0
    for _ in range(6):
        new = books + rng.integers(-12, 13, books.shape)
        drift = np.sqrt(((new - books) ** 2).sum(axis=1)) + 1e-9
        books = new
        full += vector_codes.moved(x, near, up, low, books, drift) == 16
        d = ((x[:, None] - books) ** 2).sum(axis=2)
        apart = np.sqrt(d)
        assert np.array_equal(near[:, 0], d.argmin(axis=1)) and (up >= apart.min(axis=1) - 1e-6).all()
        rest = apart.copy()
        np.put_along_axis(rest, near.astype(int), np.inf, axis=1)
        assert (low[:, -1] <= rest.min(axis=1) + 1e-6).all()
        assert (low[:, :-1] <= np.take_along_axis(apart, near[:, 1:].astype(int), axis=1) + 1e-6).all() and (np.diff(low, axis=1) >= 0).all()
    assert full < 6


def test_codes_of_few_and_odd_vectors(spark):
    assert vector_codes.compress_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [0.5] * 16, 1, "c", 0), (2, [0.25] * 16, None, "c", 0), (3, [1.0] * 5, 1, "c", 0), (1, [0.5] * 16, 1, "c", 0), (4, [1e300] * 16, 3, "c", 0)]
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {g[0]: g[1:] for g in got}[3] == (None, None, 0) and len(got) == 4
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame(rows[2:3], VECTORS))


# ---- 13 personal data


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            sums = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sums % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    random.seed(5)
    pieces = ["a", "Z", "7", "41", "4111111111111111", "@", ".", "-", "+", " ", "(", ")", "x.y@b.co", "1.2.3.4", "256.1.1.1", "+1 (017) 555-7713", "é", "\n", "%", "@@", "٣"]
    for _ in range(4000):
        text = "".join(random.choices(pieces, k=random.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def number(rng, n):
    """n digits that pass the card checksum."""
    digits = "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    return next(digits + d for d in "0123456789" if pii.luhn(digits + d))


def made_docs(n, seed):
    rng, out = random.Random(seed), []
    words = "the river runs over stone under old bridge toward sea".split()
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        made = [
            f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), number(rng, 16),
            f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", str(rng.randint(10**9, 10**14)), f"{rng.randint(2000, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", str(rng.randint(1, 99)),
        ]
        for _ in range(rng.randint(0, 2)):
            text.insert(rng.randint(0, len(text)), rng.choice(made))
        out.append((i, " ".join(text)))
    return out


DOCS = "doc_id long, text string, found string, spans string, n_ip int"


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit_segments(spark.createDataFrame([(*r, "f", "s", 1) for r in made_docs(1_500, 1)], DOCS))


def test_model_finds_held_out_spans_alone(model):
    hit = wrong = missed = 0
    for _, text in made_docs(600, 2):
        own, base = set(pii.all_spans(text, [], model)), set(pii.base_spans(text))
        hit, wrong, missed = hit + len(own & base), wrong + len(own - base), missed + len(base - own)
    assert hit > 200 and hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_model_adds_what_the_patterns_miss(model):
    card, other = number(random.Random(3), 16), number(random.Random(4), 16)
    text = f"pay {card} {other} or +1 (826) 555-4081 190.137.2.9 now"
    spans = pii.all_spans(text, pii.base_spans(text), model)
    assert {(k, text[a:b]) for k, a, b in spans} == {("card", card), ("card", other), ("phone", "+1 (826) 555-4081"), ("ip", "190.137.2.9")}
    assert pii.redact(text, spans) == "pay [card] [card] or [phone] [ip] now"
    for clean in ("born 2024-01-05 10:20:30 in 1999", "id 12345678901234", "version 1.2.300.4", "at 3 of 10 (at) noon", "price 1,234,567.89"):
        assert pii.all_spans(clean, pii.base_spans(clean), model) == pii.base_spans(clean), clean


def divisions(n, found):
    """All ways to divide n tokens into candidates with a kind and single tokens outside."""
    ways = {0: [[]]}
    for t in range(1, n + 1):
        ways[t] = [w + [(0, None)] for w in ways[t - 1]] + [w + [(y + 1, s)] for s in found if s.last == t for w in ways[s.first] for y in range(len(pii.KINDS))]
    return ways[n]


def test_decoding_and_likelihood_match_enumeration():
    rng = np.random.default_rng(6)
    texts = ["+12 345 67 89", "1.2.3.4.5", "a@b.c"]
    for text in texts * 4:
        n, found = pii.segments(text, 0, len(text))
        found = [found[i] for i in rng.permutation(len(found))[:6]]
        model = pii.SegmentModel(rng.standard_normal((len(pii.FEATURES), 4)) / 2, rng.standard_normal((5, 5)))
        scores = dict(zip(map(id, found), model.scores(found)))

        def value(way):
            y0, total = 0, 0.0
            for y, s in way:
                total += model.moves[y0, y] + (scores[id(s)][y - 1] if s else 0)
                y0 = y
            return total

        ways = divisions(n, found)
        best = max(ways, key=value)
        assert model.decode(n, found, model.scores(found)) == [(y - 1, s) for y, s in best if s]
        gold = [(s.first, s.last, y - 1) for y, s in ways[len(ways) // 2] if s]
        fit = pii.Likelihood([(n, found, gold)] * 2)
        got, by_weight, by_move = fit.gradient(model)
        want = 2 * (value(ways[len(ways) // 2]) - np.log(sum(np.exp(value(w)) for w in ways)))
        assert np.isclose(got, want)
        for array, grad in ((model.weights, by_weight), (model.moves, by_move)):
            at = tuple(rng.integers(0, s) for s in array.shape)
            array[at] += 1e-6
            up = fit.gradient(model)[0]
            array[at] -= 1e-6
            assert np.isclose((up - got) / 1e-6, grad[at], atol=1e-3)


def test_personal_data_of_odd_documents(spark, model):
    big = 2**60 + 1
    texts = [(1, None), (2, ""), (3, " \n"), (None, "mail a@b.co"), (4, "x@y.zz"), (4, "x@y.zz"), (big, "é 😀 1.2.3.4"), (5, "a" * 300_000 + "@b.cc"), (6, "7" * 200_000), (7, "1 " * 100_000), (8, "@" * 50_000), (9, "+" + "(" * 50_000), (10, "中" * 200_000)]
    df = spark.createDataFrame([(*t, "f", "s", 1) for t in texts], DOCS).repartition(3)
    got = rows_of(pii.digest_spans(pii.find_spans(df, model)))
    assert sorted(str((r["doc_id"], r["base_sha256"])) for r in got) == sorted(str((i, hashlib.sha256(pii.written(plain_spans(t) if len(t or "") < 1000 else pii.base_spans(t)).encode()).hexdigest())) for i, t in texts)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[big]["spans"] == "ip:4:11" and by_id[5]["spans"] == "email:0:300005" and by_id[1]["spans"] == by_id[2]["spans"] == "" and by_id[None]["n_email"] == 1
    assert pii.find_spans(df.limit(0), pii.fit_segments(df.limit(0))).count() == 0
    nothing = pii.fit_segments(df.where("doc_id = 10"))
    assert pii.all_spans("+1 (826) 555-4081", [], nothing) == []
