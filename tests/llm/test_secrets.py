"""Secrets against plain loops over patterns and tests, and planted random strings."""

import hashlib
import math
import random
import re
import statistics
from collections import Counter

import pytest

from shopgrain.llm import secrets as s

COLUMNS = "doc_id long, text string, spans string"
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
}


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            if len(m.group(1) if kind == "assign" else m.group()) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, stop) for start, _, kind, stop in sorted(out)]


def normal(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def brute(texts):
    """Candidates, tests and step-up rule, one at a time."""
    pairs, candidates = Counter(), []
    for at, text in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            run = m.group()
            if len(run) < s.MIN_RUN:
                pairs.update(zip(run, run[1:]))
                continue
            name = min((e for e, a in s.ENCODINGS.items() if set(run) <= set(a)), key=lambda e: len(s.ENCODINGS[e]))
            candidates.append((at, m.start(), m.end(), run, name))
    families = {}
    judged = []
    for at, start, stop, run, name in candidates:
        alphabet = s.ENCODINGS[name]
        n, k = len(run), len(alphabet)
        values = [alphabet.index(c) for c in run]
        chi = sum((values.count(v) - n / k) ** 2 / (n / k) for v in range(k))
        sides = [v >= k // 2 for v in values]
        changes = sum(a != b for a, b in zip(sides, sides[1:]))
        up = sum(sides)
        both = 2 * up * (n - up)
        spread = both * (both - n) / (n * n * (n - 1))
        mean = statistics.fmean(values)
        power = sum((v - mean) ** 2 for v in values)
        ps = [normal(-(chi - k + 1) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
        ps.append(2 * normal(-abs((changes - both / n) / math.sqrt(spread))) if spread > 0 else 0)
        r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / power if power else 99
        ps.append(2 * normal(-abs((r + 1 / n) * math.sqrt(n))))
        step = 0
        if min(ps) >= s.REJECT / 3:
            own = {(a, b): pairs[a, b] + 1 for a in alphabet for b in alphabet}
            total = sum(own.values())
            share = [sum(own[a, b] for a in alphabet) / total for b in alphabet]
            half = set(alphabet[k // 2:])
            rate = sum(c for (a, b), c in own.items() if (a in half) != (b in half)) / total
            s2, s3 = sum(x ** 2 for x in share), sum(x ** 3 for x in share)
            var = 4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 ** 2
            p = normal((chi - (k * (1 + (n - 1) * s2) - n)) / (k / n * math.sqrt(var)))
            part = changes / (n - 1)
            if part > rate:
                gap = part * math.log(part / rate) + ((1 - part) * math.log((1 - part) / (1 - rate)) if part < 1 else 0)
                p = min(p, math.exp(-(n - 1) * gap))
            step = max(0, math.floor(-math.log10(2 * p) * s.STEPS)) if p > 1e-299 else s.MOST_STEPS
        family = math.floor(2 * math.log2(n))
        families.setdefault(family, {})[run] = step
        judged.append((at, start, stop, family, step))
    least = {}
    for family, steps in families.items():
        for cut in sorted(set(steps.values())):
            if len(steps) * 10 ** (-cut / s.STEPS) <= s.FALSE_SHARE * sum(x >= cut for x in steps.values()):
                least[family] = cut
                break
    out = [[] for _ in texts]
    for at, start, stop, family, step in judged:
        if family in least and step >= least[family]:
            out[at].append((start, stop))
    return out


def expected(texts):
    rows = []
    for text, more in zip(texts, brute([t or "" for t in texts])):
        own = base(text or "")
        kinds = Counter(k for k, _, _ in own)
        added = [("random", a, b) for a, b in more if not any(x <= a and b <= y for _, x, y in own)]
        every = sorted(own + added, key=lambda x: (x[1], s.KINDS.index(x[0])))
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        rows.append((*(kinds[k] for k in s.KINDS[:3]), hashlib.sha256(join(own).encode()).hexdigest(), join(every), len(added)))
    return rows


def secret(draw, alphabet, n):
    return "".join(draw.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def given(spark, smallest_dir):
    return [r.text for r in spark.read.parquet(f"{smallest_dir}/documents.parquet").orderBy("doc_id").collect()]


def result(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], COLUMNS).repartition(3)
    return [tuple(r)[1:] for r in sorted(s.summarize(s.spans(docs)).collect())]


def test_equals_plain_loops(spark, given):
    draw = random.Random(5)
    texts = given[:120] + [
        None, "", "é" * 3 + ' "API_KEY" : \'abc=DEF/9\' tokenſ = "ſecret1"', "secret=ab passwd = abcdef", "token==abcdef, TOKEN:'x.y-z_1'",
        "xAKIA" + "A1" * 9 + " AKIA123 " + "0123456789abcdef" * 2 + "é", "a" * 500, "ab" * 300, "x-" * 40, "/usr/local/lib/python/site-packages/some_package",
        "CamelCaseIdentifierWithManyWords and some_snake_case_identifier_here", "deadbeef" * 3, " ".join(secret(draw, s.SYMBOLS, 5) for _ in range(30)),
        *["漢 " + secret(draw, a, n) + "=" for a in s.ENCODINGS.values() for n in (15, 16, 31, 40, 200)], "x" * 200_000 + " " + secret(draw, s.SYMBOLS, 100_000),
        *["copy " + "9f" * 4 + "Zq3Xw8Lm2Vb7Nc5Rt1Yp6Kd4Hs0"] * 50,
    ]
    assert result(spark, texts) == expected(texts)


def test_random_strings_are_found_and_text_is_left_alone(spark, given):
    draw = random.Random(9)
    texts, planted = list(given), {}
    for name in ("base62", "base64", "base64url", "base36"):
        for n in (40, 64):
            for _ in range(10):
                planted[len(texts)] = (name, n)
                texts.append("some words before " + secret(draw, s.ENCODINGS[name], n) + " and after")
    rows = result(spark, texts)
    assert sum(rows[k][-1] for k in planted) >= 0.9 * len(planted)
    assert sum(r[-1] > 0 for r in rows[:len(given)]) <= 0.01 * len(given)


def test_empty_table(spark):
    assert s.summarize(s.spans(spark.createDataFrame([], COLUMNS))).collect() == []


@pytest.mark.parametrize("texts", [[None], ["", None], ["short words only"], ["password: hunter22"], ["x" * 16]])
def test_texts_without_candidates(spark, texts):
    assert result(spark, texts) == expected(texts)
