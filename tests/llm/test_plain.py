"""Statistics and pseudonyms against plain versions: what is counted, what is found, and the way back under the key."""

import datetime
import math
import random
import re

import numpy as np
import pytest

from evigraph.llm import pii, quality

WORD = rb"[^\x20\x09-\x0D]+"


def plain_statistics(text):
    """The sixteen numbers of one text, by the definitions in words."""
    words = re.findall(WORD, text)
    lines = [x for x in text.split(b"\n") if re.search(WORD, x)]
    bare = [re.search(rb"[^\x20\x09-\x0D](?:.*[^\x20\x09-\x0D])?", x, re.S)[0] for x in lines]  # from the first to the last word
    some, chars, many = len(words) + quality.USUAL_WORDS, len(text) + quality.USUAL_CHARS, len(lines) + quality.USUAL_LINES
    count = lambda of: sum(c in of for c in text)
    upper = sum(sum(65 <= c <= 90 for c in w) > 1 and not any(97 <= c <= 122 for c in w) for w in words)
    return [
        math.log(some), math.log1p((sum(map(len, words)) + quality.USUAL_WORDS * quality.USUAL_LENGTH) / some), math.sqrt(upper / some), math.sqrt(count(b"#*$%&<>") / chars), math.sqrt(count(b"!") / chars), math.sqrt(count(b"|") / chars),
        math.sqrt(count(b"0123456789") / chars), math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / some), (len(set(words)) + quality.USUAL_WORDS * quality.USUAL_DISTINCT) / some, math.log(many), math.log1p(len(words) / many),
        math.sqrt((len(bare) - len(set(bare))) / many), math.sqrt((sum(w[-1] in b".!?" for w in words) + quality.USUAL_WORDS * quality.USUAL_ENDS) / some), math.sqrt(sum(c > 127 for c in text) / chars), math.sqrt(count(b",;:()\"'-") / chars),
        (sum(len(w) <= 3 for w in words) + quality.USUAL_WORDS * quality.USUAL_SHORT) / some,
    ]


def test_statistics_by_their_definitions():
    rng = random.Random(1)
    pieces = ["the", "The", "NASA", "USA!", "a|b", "x", "é", "naïve.", "$5", "100%", "(so)", "--", "end.", "\n", "\n\n", "\t", "  ", "the the", "UPPER Lower", "#tag", "\x0b", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"\n", b"same line\nsame line\n same line \nother"]
    got = quality.statistics(texts)
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for text, row in zip(texts, got):
        assert np.allclose(row, plain_statistics(text), atol=1e-12), (text, row - plain_statistics(text))


def test_fitting_is_sums_of_the_classes(spark):
    """Means, shrunk covariances and prior from numpy's own, over all labelled rows."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["lake", "Stone!", "RIVER", "12", "x|y", "and"], rng.integers(3, 40))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(80)], "doc_id long, quality int")
    model = quality.fit(quality.document_statistics(docs), labels, "quality", F.lit(True))
    x, y = quality.statistics([t.encode() for t in texts]), np.arange(80) % 3 == 0
    inner = [np.cov(x[y == c].T, bias=True) for c in (False, True)]
    share = y.mean()
    pooled = (1 - share) * inner[0] + share * inner[1]
    for c in (0, 1):
        assert np.allclose(model.means[c], x[y == c].mean(axis=0))
        shrunk = (1 - quality.TO_DIAGONAL - quality.TO_POOLED) * inner[c] + quality.TO_DIAGONAL * np.diag(np.diag(inner[c])) + quality.TO_POOLED * pooled + np.diag(quality.FLOOR * np.maximum(x.var(axis=0), 1e-9))
        factor = np.linalg.inv(model.inverses[c])
        assert np.allclose(factor @ factor.T, shrunk, atol=1e-9) and math.isclose(model.logs[c], np.linalg.slogdet(shrunk)[1], rel_tol=1e-4)  # constant statistics have next to no variance
    assert math.isclose(model.prior, share)


def back(p, y):
    """The number that a permutation sends to ``y``."""
    return p._walk((p._walk(y, False) - p.shift) % p.n, True)


@pytest.mark.parametrize("key", [b"one", b"another"])
def test_the_key_leads_back(key):
    made, rng = pii.Pseudonyms(key), random.Random(4)
    for _ in range(60):
        ip = [rng.randrange(256) for _ in range(4)]
        out = made.replace(".".join(map(str, ip)))[0]
        assert back(made.permutation(1 << 32, b"ip"), int.from_bytes(bytes(map(int, out.split("."))), "big")) == int.from_bytes(bytes(ip), "big") and out != ".".join(map(str, ip))
        day = datetime.date.fromordinal(rng.randint(pii.FIRST_DAY, pii.LAST_DAY))
        out = made.replace(day.isoformat())[0]
        assert pii.FIRST_DAY + back(made.permutation(pii.LAST_DAY - pii.FIRST_DAY + 1, b"date"), datetime.date.fromisoformat(out).toordinal() - pii.FIRST_DAY) == day.toordinal()
        area, group, serial = rng.choice([1, 665, 667, 899, 123]), rng.randint(1, 99), rng.randint(1, 9999)
        a, g, s = map(int, made.replace(f"{area:03}-{group:02}-{serial:04}")[0].split("-"))
        place = lambda v: v - 1 - (v > 666)
        assert a not in (0, 666) and back(made.permutation(898 * 99 * 9999, b"ssn"), (place(a) * 99 + g - 1) * 9999 + s - 1) == (place(area) * 99 + group - 1) * 9999 + serial - 1


def test_planted_values_and_nothing_else(spark):
    """Documents of plain words with values between them: exactly those change, each kind within its format, equal ones alike."""
    rng, words = random.Random(6), "the lake and stones of room 7b were seen, often: (so) a-b v1.2x".split()

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return body + str(-pii._luhn_sum(body + "0") % 10)

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return f"DE{98 - pii._mod97('DE00' + body):02}{body}"

    makers = {
        "email": lambda: f"{rng.choice('abcxyz')}{rng.randint(10, 99)}.q@mail{rng.randint(1, 3)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "iban": iban, "date": lambda: f"{rng.randint(1950, 2049)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        "ssn": lambda: f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}", "phone": lambda: f"+1 ({rng.randint(201, 989)}) 555-{rng.randint(0, 9999):04}",
    }
    pool = [(kind, make()) for kind, make in makers.items() for _ in range(6)]
    rows, want = [], {}
    for k in range(80):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts += [(None, rng.choice(words)) for _ in range(rng.randint(1, 5))] + ([rng.choice(pool)] if rng.random() < 0.6 else [])
        rows.append((k, " ".join(v for _, v in parts)))
        want[k] = parts
    found = pii.pseudonyms_and_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), b"key").collect()
    became: dict = {}
    for r in found:
        at = 0
        for kind, value in want[r.doc_id]:
            out = r.text[at : at + len(value)] if kind not in ("ip",) else re.match(r"[\d.]+", r.text[at:])[0].rstrip(".")
            at += len(out) + 1
            if kind is None:
                assert out == value
                continue
            assert became.setdefault((kind, value), out) == out != value
            assert re.sub(r"[a-z]", "a", re.sub(r"\d", "0", out)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "0", value)) or kind == "ip"
        assert at == len(r.text) + 1
        assert all(r[f"n_{kind}"] == sum(k == kind for k, _ in want[r.doc_id]) for kind in makers)
    assert len(set(became.values())) == len(became)  # different values stay different
    assert all(pii.luhn(out) for (kind, _), out in became.items() if kind == "card") and all(pii._mod97(out) == 1 for (kind, _), out in became.items() if kind == "iban")
