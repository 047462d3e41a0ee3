"""Personal data against plain regular expressions, and the votes' reliabilities."""

import hashlib
import random
import re

import pytest

from rotaloom.llm import personal_data as D

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return kind == "email" or all(int(p) <= 255 for p in match.split("."))


def brute(text):
    found = [[(k, m.start(), m.end()) for m in re.finditer(p, text) if fine(k, m[0])] for k, p in RULES.items()]
    return [len(f) for f in found], ",".join(f"{k}:{a}:{b}" for f in found for k, a, b in f)


def texts():
    rng = random.Random(3)
    out = [
        "", " a@b.com_x@y.org z@q a.b@c..d.e x@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 .1.2.3.4",
        "4111 1111 1111 1111  4111-1111-1111-1111 4111 1111 1111 1111 1", "+1 (555) 123-4567 +12 +1 2 3 4 5 6 7 8 9. ++49 30 1234567",
        "😀a@b.co 😀 +1 555 123 4567é a@b.c.", "1 " * 9000, "9" * 9000, "a@b" + ".c" * 5000, "-4111111111111111- 4111  1111",
    ]
    return out + ["".join(rng.choice("a1.@+ -%(4)9") for _ in range(80)) for _ in range(300)]


def test_base_spans(spark):
    rows = list(enumerate(texts())) + [(9000, "a@b.co"), (9000, "a@b.co")]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").selectExpr("*", "1 as spans", "2 as _row").repartition(4)
    got = D.find(docs).collect()
    assert len(got) == len(rows) + 1
    want = dict(rows)
    for r in got:
        counts, spans = brute(want.get(r.doc_id) or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, want.get(r.doc_id)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.spans.startswith(spans)


def test_reliabilities_recover_the_labelers(spark):
    """Votes drawn from known reliabilities give them back."""
    rng = random.Random(5)
    n = {}
    for _ in range(40_000):
        hit = rng.random() < 0.3
        vote = tuple(int((rng.random() < q) == hit) if rng.random() < 0.8 else None for q in (0.95, 0.9, 0.8))
        n[vote] = n.get(vote, 0) + 1
    counts = spark.createDataFrame([(list(v), c) for v, c in n.items()], "v array<int>, n long")
    m = D.reliabilities(counts).select("m.*").first()
    assert m.p == pytest.approx(0.3, abs=0.05)
    assert m.a == pytest.approx([0.95, 0.9, 0.8], abs=0.05) and m.b == pytest.approx([0.95, 0.9, 0.8], abs=0.05)


def test_method_adds_announced_secrets(spark):
    rng = random.Random(1)
    rows = [(i, f'on the way token = "{rng.randrange(16**40):040x}" and so on') for i in range(30)]
    rows += [(100 + i, f"call it part{rng.randrange(10**6)}number and the rest of it") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in D.find(docs).collect()}
    assert all("secret:20:60" in got[i] for i in range(30)) and not any("secret" in got[i] for i in range(100, 160))
    masked = {r.doc_id: r.text for r in D.mask(docs, D.find(docs)).collect()}
    assert masked[0] == 'on the way token = "<secret>" and so on' and masked[100] == dict(rows)[100]


def test_empty(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.n_email, r.spans) for r in D.find(docs).collect()] == [(0, "")]
    assert D.find(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    from rotaloom.llm import exact_dedup, mixing, quality

    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    for df in (D.find(docs), quality.judge(docs), mixing.plan(docs), exact_dedup.exact_groups(docs), quality.features(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_dense_text_is_linear(spark):
    """A megabyte of spans, each of which a plain expression finds as well, and masking without any of them left."""
    import time

    rng = random.Random(2)
    text = "".join(f"u{rng.randrange(10**5)}@mail.example.org token {rng.randrange(16**20):020x} " for _ in range(17_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    found = D.find(docs)
    row = found.first()
    assert time.time() - start < 40
    counts, spans = brute(text)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
    assert row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert "@" not in D.mask(docs, found).first().text


def test_candidates_keep_clear_of_rules(spark):
    text = "x 4111111111111111 abcd1234efgh 10.20.30.40 a1b2c3d4e5@mail.example.org zz99zz99 tail"
    docs = spark.createDataFrame([(text,)], "_text string")
    kinds = D._base(docs["_text"])
    got = docs.select(*[v.alias(k) for k, v in kinds.items()]).select("*", D._candidates(D.F.lit(text), [D.F.col(k) for k in kinds]).alias("c")).first()
    taken = [(x.s, x.e) for k in kinds for x in got[k]]
    runs = [(m.start(), m.end()) for m in re.finditer(r"(?<![\w+/-])(?=[\w+/-]{8})(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]+", text)]
    assert [(x.s, x.e) for x in got.c] == [r for r in runs if not any(a < r[1] and r[0] < b for a, b in taken)]
    assert all(text[x.s : x.e] == x.m and text[: x.s].endswith(x.b) for x in got.c)


def test_mask_joins_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "0123456789abc"), (2, None), (3, "none")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "card:2:5,phone:0:4,ip:4:6,id:8:10"), (2, ""), (3, "")], "doc_id long, spans string")
    got = {r.doc_id: r.text for r in D.mask(docs, found).collect()}
    assert got == {1: "<phone>67<id>abc", 2: None, 3: "none"}
