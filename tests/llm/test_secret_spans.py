"""All spans of a table, base and added, against a scan in Python that shares no code with the columns."""

import collections
import math
import random
import re
import string

from pyspark.sql import functions as F

from scriptorium.llm import preferences, secrets

RUN = re.compile("[A-Za-z0-9+/_-]{20,}")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LOW, UP, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits


def alphabet(v):
    if v.isalpha():
        return ("base26", LOW, v.lower()) if v.islower() or v.isupper() else ("base52", UP + LOW, v)
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v):
        return "hex", DIGITS + "abcdef", v.lower()
    if re.fullmatch("[A-Z2-7]+", v):
        return "base32", UP + "234567", v
    if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", v):
        return "base36", DIGITS + LOW, v.lower()
    return "base64", UP + LOW + DIGITS + "+/", v.translate(str.maketrans("-_", "+/"))


def p_value(v):
    """Encoding, band and joint p-value of a run."""
    enc, letters, v = alphabet(v)
    a, n, x = len(letters), len(v), [letters.index(c) for c in v]
    tail = lambda z: math.erfc(max(z, 0) / 2**0.5) / 2
    equal, two, p = sum(k * (k - 1) / 2 for k in collections.Counter(x).values()), n * (n - 1) / 2, 1 / a
    var = two * p * (1 - p)
    skew = (var * (1 - 2 * p) + 2 * two * (n - 2) * p * p * (1 - p)) / var**1.5
    y, ninth = (equal - 0.5 - two * p) / var**0.5, skew * skew / 36
    pairs = tail((max(1 + skew * y / 2, 0) ** (1 / 3) - 1 + ninth) / ninth**0.5)
    high = [2 * c >= a for c in x]
    turns, up = 1 + sum(s != t for s, t in zip(high, high[1:])), sum(high)  # noqa: B905
    prod = 2 * up * (n - up)
    spread = prod * (prod - n) / (n * n * (n - 1))
    runs = 2 * tail((abs(turns - prod / n - 1) - 0.5) / spread**0.5) if spread > 0 else 2.0 ** (1 - n)
    mean = sum(x) / n
    around = sum((c - mean) ** 2 for c in x)
    cross = sum((s - mean) * (t - mean) for s, t in zip(x, x[1:]))  # noqa: B905
    serial = 2 * tail(abs(cross / around + 1 / n) / ((n - 2) / (n * (n - 1) ** 0.5))) if around > 0 else float(a) ** (1 - n)
    return enc, 20 if n < 32 else 32 if n < 64 else 64 if n < 128 else 128, min(1.0, 3 * min(pairs, runs, serial))


def brute(texts, q=0.05):
    """For each text its base spans and candidates with their p-values, and the strata's largest rejected p-values."""
    rows, strata = [], collections.defaultdict(list)
    for t in texts:
        base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        runs = []
        for m in RUN.finditer(t):
            v = m[0]
            if v.isalpha() and len(v) >= 32 or re.search("[0-9]", v) and re.search("[A-Za-z]", v):
                enc, band, p = p_value(v)
                strata[enc, band].append(p)
                runs.append((m.start(), m.end(), enc, band, p))
        rows.append((sorted(base), runs))
    cut = {k: max((x for i, x in enumerate(sorted(ps), 1) if x <= q * i / len(ps)), default=-1.0) for k, ps in strata.items()}
    return rows, cut


def texts(seed):
    rng = random.Random(seed)
    kinds = [(DIGITS + "abcdef", 40), (UP + LOW + DIGITS, 24), (LOW, 40), (UP + LOW, 40), (UP + "234567", 32), (UP + LOW + DIGITS + "+/", 130)]
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 5)):
            letters, n = rng.choice(kinds)
            key = "".join(rng.choices(letters, k=n + rng.randint(0, 5)))
            regular = rng.choice(["Ab1" * 12, "a" * 30, "AB" * 15, "é", "abcdefghijklmnopqrstuvwxyz0123456789", "word-with-many-parts-in-it", "path/to/some/file/of/mine", "x1" * 20])
            parts.append(rng.choice([key, f"token={key}", f'Secret : "{key}.{key}"', regular, f"password: {regular}", f"AKIA{key.upper()}", "😀 plain words"]))
        out.append(rng.choice([" ", "\n", ", "]).join(parts))
    return out


def test_all_spans_against_python(spark):
    some = texts(1)
    d = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(d).collect()}
    rows, cut = brute(some)
    added = 0
    for k, (base, runs) in enumerate(rows):
        told = [tuple(s.split(":")) for s in got[k].split(",") if s]
        assert sorted((int(a), int(b), kind) for kind, a, b in told if kind != "random") == base
        random_ = {(int(a), int(b)) for kind, a, b in told if kind == "random"}
        for a, b, enc, band, p in runs:
            apart = not any(x < b and a < y for x, y, _ in base)
            edge = cut[enc, band] > 0 and abs(math.log(p) - math.log(cut[enc, band])) < 0.05  # a cell of the histogram
            if apart and not edge:
                assert ((a, b) in random_) == (p > cut[enc, band]), (some[k][a:b], p)
                added += p > cut[enc, band]
            elif not apart:
                assert (a, b) not in random_
        assert random_ <= {(a, b) for a, b, *_ in runs}
    assert added > 100


def test_keys_of_letters_alone(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choices(UP + LOW, k=40)) for _ in range(200)] + ["".join(rng.choices(LOW, k=40)) for _ in range(200)]
    regular = ["abcdefghijklmnopqrstuvwxyzabcdef", "a" * 40, "Haha" * 9, "internationalizationally"] * 15
    d = spark.createDataFrame([(k, f"the key {v} here") for k, v in enumerate(keys + regular)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(d).where("n_random = 1").collect()}
    assert len(found & set(range(400))) >= 380 and not found & set(range(400, 460))


def test_a_hot_prompt_goes_to_many_places(spark, monkeypatch):
    """Broadcast leaders and dealt copies of them give the same pairs."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 and c % 3 else f"{c}.{t}") for c in range(60) for t in range(4)]
    d = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    want = sorted(tuple(r) for r in preferences.preferences(d).collect())
    monkeypatch.setattr(preferences, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(preferences, "DEALT", 7)
    assert sorted(tuple(r) for r in preferences.preferences(d).collect()) == want
    monkeypatch.setattr(preferences, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in preferences.preferences(d).collect()) == want and sum("same_prompt" in r for r in want) == 39
