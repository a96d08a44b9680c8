import re

import pytest

from seriate.llm import pii

CARD = "4619646426088949"


def luhn(s):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(s))) % 10 == 0


def run(docs_of, texts, key=None):
    df = docs_of(list(enumerate(texts)))
    return [r.text for r in pii.pseudonymise(df, key or pii.KEY).orderBy("doc_id").collect()]


VALID = [CARD, "4619-6464-2608-8949", "4619 6464 2608 8949", "378282246310005", "78.241.210.149", "0.0.0.0", "255.255.255.255", "2024-02-29", "1800-01-01", "2199-12-31", "+1 (869) 555-7420", "(969) 555-7420", "123-45-6789", "899-99-9999", "ab.C-9@mail1.example.com", "8824c3a463b8b0d68516db48c461547d5799bf8b", "(017) 155-7420", "8824C3A463B8B0D68516DB48C461547D5799BF8B"]
INVALID = ["4619646426088948", "256.1.1.1", "01.2.3.4", "2023-02-29", "2024-13-01", "000-45-6789", "666-45-6789", "123-00-6789", "123-45-0000", "12345", "v1.2.3"]


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))


def test_values_keep_their_format_and_validity(docs_of):
    got = run(docs_of, [f"x {v}, y {v}." for v in VALID])
    for v, t in zip(VALID, got, strict=True):
        a, b = re.fullmatch(r"x (.+), y (.+)\.", t).groups()
        assert a == b and a != v
        digits = re.sub(r"\D", "", v)
        if "@" in v:
            assert a.endswith("@mail1.example.com") and shape(a) == shape(v)
        elif len(v) == 40:
            assert re.fullmatch("[0-9a-f]{40}|[0-9A-F]{40}", a) and [c.isdigit() for c in a] == [c.isdigit() for c in v]
        elif "." in v:
            assert all(0 <= int(o) <= 255 for o in a.split("."))
        else:
            assert shape(a) == shape(v)
            if v in VALID[:4]:
                assert luhn(re.sub(r"\D", "", a))
            if len(digits) == 8:
                import datetime

                datetime.date.fromisoformat(a)
    # The same number with other separators stays linked.
    assert len({re.sub(r"\D", "", got[k][2:].split(",")[0]) for k in (0, 1, 2)}) == 1


def test_invalid_values_nulls_and_empty_texts_stay(docs_of):
    texts = [f"x {v} y" for v in INVALID] + [None, "", "no data @ all", "plain"]
    assert run(docs_of, texts) == texts


def test_keys_differ_and_long_texts_are_rewritten_whole(docs_of):
    texts = ["w " * 50_000 + CARD + " é " + CARD]
    a, b = run(docs_of, texts), run(docs_of, texts, "other")
    assert a != b and CARD not in a[0] and a[0].startswith("w w ") and len(a[0]) == len(texts[0])


@pytest.mark.parametrize("a,b", [(7, 5), (189, 773), (16, 16)])
def test_pairs_are_permuted(spark, a, b):
    from pyspark.sql import functions as F

    df = spark.range(a * b).select(pii.pair(F.floor(F.col("id") / b), F.col("id") % b, a, b, "k", "x", lambda x, y: x * b + y).alias("v"))
    assert sorted(r.v for r in df.collect()) == list(range(a * b))


def test_strings_are_permuted(spark):
    from pyspark.sql import functions as F

    rows = [(f"{x}{y}.{z}",) for x in "abcdef" for y in range(10) for z in "uvwxyz"]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(pii.string(F.col("s"), "k", "mail")).collect()]
    assert len(set(got)) == len(rows) and all(re.fullmatch(r"[a-z]\d\.[a-z]", g) for g in got)


def test_more_dates_long_secrets_and_short_names(docs_of):
    texts = ["due 25.12.2020 ok", "due 12/31/1999 ok", "due 31/12/1999 ok", "due 31.02.2020 ok", "f" * 80, "a@x.org a@y.org a@z.org a@w.org", "at 2024-02-29T10:00:00Z"]
    got = {r.doc_id: r.text for r in pii.op3(docs_of(list(enumerate(texts)))).collect()}
    import datetime

    for k, form in ((0, "%d.%m.%Y"), (1, "%m/%d/%Y"), (2, "%d/%m/%Y")):
        assert got[k] != texts[k] and datetime.datetime.strptime(got[k][4:14], form) and got[k].endswith(" ok")
    assert got[3] == texts[3] and got[4] != texts[4] and len(got[4]) == 80
    assert len({x[0] for x in got[5].split()}) > 1 and got[6].endswith("T10:00:00Z") and got[6] != texts[6]


def test_query(docs_of):
    rows = pii.op3(docs_of([(1, f"{CARD} and 4619646426088948"), (2, None), (2, None)])).orderBy("doc_id").collect()
    assert [(r.n_found, r.n_replaced) for r in rows] == [(2, 1), (0, 0), (0, 0)]
    assert pii.op3(docs_of([])).count() == 0


def test_no_python_on_the_executors(docs_of):
    plan = pii.op3(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_cards_beside_other_numbers(docs_of):
    alone = run(docs_of, [CARD, "4619 6464 2608 8949", "123-45-6789"])
    texts = [f"{CARD} 12/26", "4619 6464 2608 8949 123", f"order 7 {CARD}", f"1234 5678 4619 6464 2608 8949 {CARD}", f"123-45-6789 {CARD}"]
    want = [f"{alone[0]} 12/26", f"{alone[1]} 123", f"order 7 {alone[0]}", f"1234 5678 {alone[1]} {alone[0]}", f"{alone[2]} {alone[0]}"]
    assert run(docs_of, texts) == want


def test_phones_and_dates_in_other_forms_stay_linked(docs_of):
    forms = ["(743) 555-3824", "743-555-3824", "743.555.3824", "+1 743 555 3824", "+17435553824", "+1-743-555-3824"]
    got = run(docs_of, [f"x {v} y" for v in forms] + ["2024-02-29 z", "2024-02-29T10:00:00Z"])
    assert all(shape(a) == shape(f"x {v} y") for v, a in zip(forms, got))
    assert len({re.sub(r"\D", "", a)[-10:] for a in got[:6]} - {"7435553824"}) == 1
    assert got[7] == got[6][:10] + "T10:00:00Z" != "2024-02-29T10:00:00Z"
