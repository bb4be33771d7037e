from __future__ import annotations

import re

from pyspark.sql import functions as F

from loglake.llm.op10_pii import GIVEN, _written, draw_surrogates, replace_personal_data

MAIL, IP, CARD = r"[\w.]+@[\w.]+\w", r"\d+\.\d+\.\d+\.\d+", r"\b\d{16}\b"
PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"


def replaced(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(replace_personal_data(df, **options).collect())
    return [r.text for r in rows], [r.n_entities for r in rows]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_formats(spark):
    text = (
        "X 4111 1111 1111 1111, 4111111111111111; 1234-5678-9012-3456 10.1.2.3 192.168.3.4 8.8.8.8. "
        "DE89 3704 0044 0532 0130 00 123-45-6789 938-555-1226 +1 (938) 555-1226 Jo.Doe@Mail.Example.org jo.doe@mail.example.org"
    )
    (new,), (n,) = replaced(spark, [text])
    assert n == 12
    old, out = text.split(" "), new.split(" ")
    shape = [re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", x))) for x in (text, new)]
    assert len(old) == len(out)
    digits = [re.sub(r"\D", "", x) for x in (" ".join(out[1:5]), out[5])]
    assert digits[0] == digits[1] != "4111111111111111" and luhn(digits[0]) and not luhn(out[6])
    assert shape[0][:62] == shape[1][:62]
    assert out[7].startswith("10.") and out[8].startswith("192.168.") and out[9].endswith(".")
    assert out[-1] == out[-2] and out[-1].endswith(".org") and re.fullmatch(MAIL, out[-1])
    assert "DE" in out and out[0] == "X" if "DE" in out else out[10].startswith("DE")


def test_names_keep_gender_script_and_reference(spark):
    texts = ["Mrs. Anna Smith met Mr Smith.", "Mr Smith left; Frau Müller and Г-жа Анна Иванова stayed.", "Κύριος Νίκος Παππάς"]
    new, n = replaced(spark, texts)
    assert n == [2, 3, 1]
    given, family = re.match(r"Mrs\. (\w+) (\w+) met", new[0]).groups()
    assert given in GIVEN["latin", "f"].split() and family.isalpha()
    assert re.search(r"met Mr (\w+)\.", new[0])[1] == re.match(r"Mr (\w+) left", new[1])[1]
    assert re.search(r"Г-жа (\w+) \w+", new[1])[1] in GIVEN["cyrillic", "f"].split()
    assert new[2].split()[1] in GIVEN["greek", "m"].split()
    assert not any(x in " ".join(new) for x in ("Smith", "Müller", "Иванова", "Παππάς"))


def test_key_decides(spark):
    texts = ["mail a.b@c.example.com"]
    one, two = replaced(spark, texts, key="one")[0], replaced(spark, texts, key="two")[0]
    assert one != two and one == replaced(spark, texts, key="one")[0]


def test_collisions_are_drawn_again(spark):
    """One-letter mailboxes of one domain: far too few surrogates for chance alone."""
    entities = spark.createDataFrame(
        [("email", f"{c}@x.example.com") for c in "abcdefghijklm"], "kind string, normal string"
    )
    got = draw_surrogates(entities, "k").collect()
    assert len({r.surrogate for r in got}) == 13
    assert not {r.surrogate for r in got} & {r.normal for r in got}


def test_other_phones_and_cards(spark):
    """International and national groupings, and cards of 13 to 19 digits if their check digit is valid."""
    found = ["+44 20 7946 0958", "+49 30 1234567", "+15551234567", "+33 1 23 45 67 89", "+34 912 345 678", "0049 30 1234567",
             "020 7946 0958", "01 23 45 67 89", "3782 822463 10005", "378282246310005", "4222222222222", "6304 0000 0000 0000 000"]
    left = ["1234567890123", "3782 822463 10006", "01-02-2024", "1 234 567 890", "2024-01-02 03:04:05", "1234 938 555"]
    new, n = replaced(spark, [f"see {x} or" for x in found + left] + ["call +44 20 7946 0958 12 times, no 1234567890123"])
    assert n == [1] * len(found) + [0] * len(left) + [1]
    for old, out in zip(found + left, new):
        assert re.sub(r"\d", "0", f"see {old} or") == re.sub(r"\d", "0", out)
        assert (out == f"see {old} or") == (old in left)
    assert all(luhn(out) for out in new[8:12])
    assert new[-1].endswith(" 12 times, no 1234567890123") and new[0][4:20] in new[-1]


def test_full_formats_are_widened(spark):
    """More entities than their format has values: all mailboxes of one letter, most private addresses, all digits."""
    mails = [("email", f"{c}@x.example.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    addresses = [("ip", f"192.168.{i // 254}.{i % 254 + 1}") for i in range(40_000)]
    digits = [("phone", str(i)) for i in range(10)]
    entities = spark.createDataFrame(mails + addresses + digits, "kind string, normal string")
    got = draw_surrogates(entities, "k", max_draws=3).collect()
    assert {(r.kind, r.normal) for r in got} == set(mails + addresses + digits) and len(got) == 40_036
    new = {(r.kind, r.surrogate) for r in got}
    assert len(new) == len(got) and not new & {(r.kind, r.normal) for r in got}
    forms = {"email": r"[a-z]+@[a-z]\.[a-z]{7}\.com", "ip": r"(192\.168|10\.\d+|2[45]\d\.\d+)\.\d+\.\d+", "phone": r"\d+"}
    assert all(re.fullmatch(forms[r.kind], r.surrogate) for r in got)


def test_longer_surrogates_are_written_whole(spark):
    row = spark.range(1).select(_written(F.lit("12-34"), F.lit("phone"), F.lit("567890")).alias("new")).first()
    assert row.new == "56-7890"


def test_documents(spark):
    """All entities go, everything else stays, and the mapping is one to one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {r.doc_id: r for r in replace_personal_data(docs).collect()}
    maps = {}
    for row in docs.collect():
        out = new[row.doc_id]
        assert (out.lang, out.source) == (row.lang, row.source)
        found = 0
        for pattern in (MAIL, IP, CARD, PHONE):
            before, after = re.findall(pattern, row.text), re.findall(pattern, out.text)
            found += len(before)
            assert len(before) == len(after)
            for a, b in zip(before, after):
                assert maps.setdefault(a, b) == b
        assert found == out.n_entities
        assert found or out.text == row.text
    assert len(maps) > 20 and len(set(maps.values())) == len(maps) and not set(maps) & set(maps.values())


def test_very_long_domains(spark):
    """Labels without end are matched in a loop; a label of digits at the end is left out of the address."""
    texts = ["x@" + "ab." * 100_000 + "com", "x@" + "1." * 100_000 + "2", "y@" + "a.1." * 1000 + "org.7 end", "z@b.com.x1, q@b..com"]
    new, n = replaced(spark, texts)
    assert n == [1, 0, 1, 1]
    assert new[0].count(".") == 100_000 and new[0].endswith(".com") and "ab.ab." not in new[0]
    assert new[1] == texts[1] and new[2].endswith(".org.7 end") and new[3].endswith(".com.x1, q@b..com")


def test_people_of_all_genders_stay_different(spark):
    entities = [(f"name_{g}", f"{g.upper()}a{i}") for g in "fmn" for i in range(1500)]
    got = draw_surrogates(spark.createDataFrame(entities, "kind string, normal string"), "k").collect()
    assert len({r.surrogate for r in got}) == len(got) == 4500


def test_odd_rows(odd, empty):
    got = replace_personal_data(odd)
    assert got.columns == [*odd.columns, "n_entities"]
    assert sorted(map(str, got.drop("n_entities").collect())) == sorted(map(str, odd.collect()))
    assert replace_personal_data(empty).count() == 0
    clash = odd.withColumns({"k1": F.lit(1), "found": F.lit("x"), "mention": F.lit(None), "row": F.lit("r")})
    assert replace_personal_data(clash, count_as="c").where("c = 0").count() == odd.count()


def test_no_python(some_docs):
    plan = replace_personal_data(some_docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))
