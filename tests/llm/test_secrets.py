import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gavel.llm import secret_scan as S

KEYWORD = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in KEYWORD.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def distance(word):
    alphabet = next((a for a in S.ENCODINGS if set(word) <= set(a)), None)
    if alphabet is None or len(word) < 2:
        return None
    kinds, size = len(alphabet), len(word)
    at = [alphabet.index(c) for c in word]
    chi = sum((Counter(at)[i] - size / kinds) ** 2 / (size / kinds) for i in range(kinds))
    uniform = (chi - (kinds - 1)) / math.sqrt(2 * (kinds - 1) * (1 - 1 / size))
    half = kinds // 2
    changes = sum((x < half) != (y < half) for x, y in zip(at, at[1:]))
    q = half / kinds * (1 - half / kinds)
    runs = (changes - (size - 1) * 2 * q) / math.sqrt((size - 1) * 2 * q * (1 - 2 * q) + 2 * (size - 2) * q * (1 - 4 * q))
    middle, variance = (kinds - 1) / 2, (kinds**2 - 1) / 12
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:])) / variance / math.sqrt(size - 1)
    return uniform**2 + runs**2 + serial**2


def step(value):
    return S.BINS if value is None else min(S.BINS, math.floor(value / S.CONSISTENT * S.BINS))


def brute(texts, rate=S.RATE):
    """Base and all spans of every text, with limits from all texts."""
    found = {}
    for i, text in texts.items():
        own, places = base(text), list(CANDIDATE.finditer(text or ""))
        gaps = CANDIDATE.split(text or "")
        for at, m in enumerate(places):
            if not re.search("[A-Za-z]", m[0]) or any(a < m.end() and m.start() < b for a, _, b in own):
                continue
            letters = re.sub("[^A-Za-z]+", "", gaps[at]) + re.sub("[^A-Za-z]+", "", gaps[at + 1])
            decoy = step(distance(letters[: len(m[0])])) if len(letters) >= len(m[0]) else None
            found.setdefault(i, []).append((m.start(), m.end(), math.floor(2 * math.log2(len(m[0]) / 16)), step(distance(m[0])), decoy))
    every = [c for own in found.values() for c in own]
    bound = {}
    for s in {c[2] for c in every}:
        real, fake = [c[3] for c in every if c[2] == s], [c[4] for c in every if c[2] == s and c[4] is not None]
        for b in sorted(set(real + fake)):
            share = sum(f <= b for f in fake) * len(real) / max(len(fake), 1)
            if b < S.BINS and share <= rate * sum(r <= b for r in real):
                bound[s] = b
    return {
        i: (base(t), sorted(base(t) + [(a, 3, b) for a, b, s, d, _ in found.get(i, []) if d <= bound.get(s, -1)])) for i, t in texts.items()
    }


def scanned(df):
    return [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in S.secrets(df).collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs while someone écrit quelques mots über 日本語 and-so-on".split()
    text = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for i in range(120)}

    def random_word(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    b64 = S.ENCODINGS[10]
    for i in range(0, 120, 3):
        kind, secret = rng.choice(S.ENCODINGS[1:]), random_word(b64, rng.choice([16, 20, 40, 64, 200]))
        text[i] += " " + rng.choice([
            f'api_key = "{secret}" end', f"Token:{secret}", f"see {secret} there, é", random_word(kind, 40), f"AKIA{random_word(S.UPPER, 16)}",
            random_word("0123456789abcdef", 32), "internationalization-of-everything/in/the/path", "aaaaaaaaaaaaaaaaaaaaaaaa",
            "abcdefghijklmnopqrstuvwxyz", "4111111111111111", f"{secret} {secret}=={secret}",
        ]) + " " + text[i]
    text |= {
        200: "", 201: None, 202: "token=mytoken: abcdefghijklmnop", 203: "PASSWD='short' secret==abcdefghijkl.", 204: "aPi_KeY : \"0123456789abcdef\"",
        205: "AKIAAKIAAKIAAKIAAK AKIA1234567890123 xAKIA12345678901234é", 206: "0123456789abcde 0123456789abcdef0 ABCDEF0123456789", 207: "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
        208: "日本🙂 token=abcdefghijklmnop 🙂 0123456789abcdef",
    }
    return text


def test_spans_against_brute_force(spark, docs, texts):
    want = brute(texts)
    got = scanned(docs([*texts.items(), (208, texts[208]), (None, "0123456789abcdef")]))
    assert sorted(got, key=repr) == sorted(
        [(i, *w) for i, w in want.items()] + [(208, *want[208]), (None, [(0, 2, 16)], [(0, 2, 16)])], key=repr
    )
    added = {texts[i][a:b] for i, (_, spans) in want.items() for a, kind, b in spans if kind == 3}
    assert len(added) >= 5 and not any("the" in word or "aaaa" in word or word.startswith("abcdefgh") for word in added)


def test_no_rows(spark, docs):
    assert scanned(docs([])) == []
    assert scanned(docs([(1, "only ordinary words")])) == [(1, [], [])]


def test_many_matches_in_one_text(spark, docs):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(16)) + rng.choice(["", "é", " word"]) for _ in range(20_000))
    ((_, own, spans),) = scanned(docs([(1, text)]))
    assert own == base(text) and [s for s in spans if s[1] < 3] == own


def test_distance_and_encodings(spark):
    words = ["deadbeef" * 3, "Zm9vYmFy+/xx", "zzzzzzzz", "a", "not base64!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "a-b_c/d+e0Z"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.distance(F.col("w")).alias("d")).collect()
    for r in rows:
        want = distance(r.w)
        assert (r.d is None and want is None) or math.isclose(r.d, want, rel_tol=1e-9, abs_tol=1e-9)


def test_random_strings_pass_the_battery():
    """One in a thousand or a little more, at every length and encoding."""
    rng = random.Random(7)
    for alphabet in S.ENCODINGS[1:]:
        for size in (16, 40, 200):
            failed = sum(distance("".join(rng.choice(alphabet) for _ in range(size))) >= S.CONSISTENT for _ in range(300))
            assert failed <= 9
