"""Personal data: the query against the patterns themselves, long runs, overlaps."""

import random
import re

from nearfield.llm import catalogue, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The fixed patterns as they are given, by start, then kind."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(a, b, pii.BASE_KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans_are_the_patterns_matches():
    r = random.Random(9)
    for alphabet in ("a1.@-_ +%", "12.. ", "0123456789 -", "+12345() .-", "+1 4.@a-"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == brute(text), text
    seen = 0
    for _ in range(2000):
        stem = [r.randrange(10) for _ in range(r.randint(13, 18))]
        text = r.choice(["", "x ", "5"]) + r.choice(["", " ", "-"]).join(map(str, [*stem, r.randrange(10)])) + r.choice(["", ".1.2.3", "-4"])
        assert pii.base_spans(text) == brute(text), text
        seen += bool(pii.base_spans(text))
    assert seen > 100


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalogue.op7_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for x in rows:
        base = brute(texts[x["doc_id"]])
        spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in x["spans"].split(","))] if x["spans"] else []
        assert x["base_sha256"] == pii.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base))
        assert [x[f"n_{kind}"] for kind in pii.BASE_KINDS] == [sum(k == kind for _, _, k in base) for kind in pii.BASE_KINDS]
        assert set(base) <= set(spans) and x["n_spans"] == len(spans) == len(base) + x["n_added"]
        added = sorted(set(spans) - set(base))
        assert all(b <= c for (_, b, _), (c, _, _) in zip(added, added[1:]))
        assert not any(a < d and c < b for a, b, _ in added for c, d, _ in base)


def test_leading_zeros_without_end(spark):
    texts = ["0" * 5000 + ".1.1.1", "1.1.1." + "0" * 4400 + "255", "1.1.1." + "0" * 4400 + "256", "9" * 5000 + ".1.1.1"]
    assert [[s[2] for s in pii.base_spans(t)] for t in texts] == [["ip"], ["ip"], [], []]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["n_ip"] for x in pii.digest(pii.find(rows)).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_long_tokens_and_secrets_without_digits():
    fitted, r = pii.model(), random.Random(3)
    coded = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    for n in (24, 126, 129, 180, 1000):
        token = coded(n)
        assert (7, 7 + n, "secret") in pii.select(f"token: {token} end", [], fitted), n
    alone, beside = "the password=qwmzkhgtrplxvbna of", "the password=qwmzkhgtrplxvbna of 7"
    assert [s[:2] for s in pii.select(alone, [], fitted)] == [s[:2] for s in pii.select(beside, [], fitted)] == [(4, 29)]
    for clean in ("=" * 300, "a-" * 400, "/usr/share/doc/some/long/path/to/another/file/in/here" * 9, "thisisaverylongwordthatnobodywouldeverwrite"):
        assert not pii.select(f"see {clean} end", [], fitted)
