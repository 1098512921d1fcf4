"""Text expressions against Python's own Unicode rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folium.functions import text as t


def upper_key(v):
    v = unicodedata.normalize("NFKD", v.strip().upper())
    return re.sub(r"\s+", " ", "".join(c for c in v if not unicodedata.combining(c))).strip()


def casefold_key(v):
    v = unicodedata.normalize("NFKD", v.casefold())
    return re.sub(r"\s+", " ", "".join(c for c in v if not unicodedata.combining(c))).strip()


def plain_lower(v):
    v = unicodedata.normalize("NFD", v.strip().lower())
    return "".join(c for c in v if unicodedata.category(c) != "Mn")


def sample_texts():
    rnd = random.Random(7)
    spans = [range(1, 0x250), range(0x300, 0x600), range(0x1E00, 0x2200), range(0x3000, 0x3400),
             range(0xAC00, 0xAD00), range(0xFB00, 0xFB50), [0x1F600, 0x1D400, 0x2F800, 0xE0100, 0x3A3]]
    letters = [chr(cp) for span in spans for cp in span]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    out += [f"a{ch}b" for ch in letters]
    return out + ["", " ", "ÁNCASH", "Straße", "ﬁn…", "한글", "á b", "x\u0085y", "　 x  ", "ŉ", "İ"]


def rows(spark, values, *columns):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return frame.select("v", *columns).collect()


def test_folding_equals_python(spark):
    v = F.col("v")
    found = rows(
        spark, sample_texts(), t.fold_upper(v).alias("u"), t.fold_lower(v).alias("l"),
        t.strip_marks_lower(v).alias("n"), t.unicode_trim(v).alias("s"),
    )
    for r in found:
        assert r["u"] == upper_key(r["v"]), ascii(r["v"])
        assert r["l"] == casefold_key(r["v"]), ascii(r["v"])
        assert r["s"] == r["v"].strip(), ascii(r["v"])
        # Pairs of lower and upper case that newer Unicode editions added differ between runtimes.
        if not any(ch in "ᲉꟋꟌꟚꟜ" for ch in r["v"]):
            assert r["n"] == plain_lower(r["v"]), ascii(r["v"])


def test_null_folds_to_blank(spark):
    v = F.col("v")
    (r,) = rows(spark, [None], t.fold_upper(v).alias("u"), t.fold_lower(v).alias("l"), t.non_empty(v).alias("e"))
    assert (r["u"], r["l"], r["e"]) == ("", "", False)


def test_blanks_and_sentinels(spark):
    v = F.col("v")
    values = [None, "", "  \t", "Otros", " OTROS ", "No aplica", "nan", "x"]
    got = rows(
        spark, values, t.non_empty(v).alias("filled"), t.is_empty_category(v).alias("empty"),
        t.is_present(v).alias("present"), t.otros_if_empty(v).alias("label"), t.is_unique_flag(v).alias("flag"),
    )
    assert [r["filled"] for r in got] == [False, False, False, True, True, True, True, True]
    assert [r["empty"] for r in got] == [True, True, True, True, True, True, False, False]
    assert [r["present"] for r in got] == [False, False, False, False, False, False, False, True]
    assert [r["label"] for r in got][:5] == ["Otros", "Otros", "Otros", "Otros", "OTROS"]


def test_unique_flag_is_not_trimmed(spark):
    got = rows(spark, ["SI", "si", " SI", "NO", None], t.is_unique_flag(F.col("v")).alias("f"))
    assert [r["f"] for r in got] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "value, number, year",
    [("2015.0", 2015.0, 2015), ("2015", 2015.0, 2015), ("nan", None, None), ("s/f", None, None), (None, None, None)],
)
def test_number_and_year(spark, value, number, year):
    (r,) = rows(spark, [value], t.to_number(F.col("v")).alias("n"), t.to_year(F.col("v")).alias("y"))
    assert (r["n"], r["y"]) == (number, year)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("19. Producción Cientifica  AN,HU,PA,SM,CA", "Producción científica AN, HU, PA, SM, CA"),
        ("3.Condor", "Cóndor"),
        (" 7. Otra \t base ", "Otra base"),
        ("Sin prefijo 3. x", "Sin prefijo 3. x"),
        (None, None),
    ],
)
def test_database_name(spark, raw, clean):
    (r,) = rows(spark, [raw], t.database_name(F.col("v")).alias("d"))
    assert r["d"] == clean


def test_thousands(spark):
    got = rows(spark, ["6217", "1234567", "-1234", "12.7", "x", None], t.thousands(F.col("v")).alias("s"))
    assert [r["s"] for r in got] == ["6 217", "1 234 567", "-1 234", "12.7", "x", None]
    numbers = spark.createDataFrame([(12999.9,), (-3.5,)], "v double").select(t.thousands(F.col("v")).alias("s"))
    assert [r["s"] for r in numbers.collect()] == ["12 999", "-3"]


def test_paths(spark):
    got = rows(spark, ["A › B › C", "A"], t.path_leaf(F.col("v")).alias("leaf"), t.path_rest(F.col("v")).alias("rest"))
    assert [(r["leaf"], r["rest"]) for r in got] == [("C", "B › C"), ("A", "A")]


def test_numeric_prefix(spark):
    got = rows(spark, ["12. x", "x 12.", None], t.has_numeric_prefix(F.col("v")).alias("p"))
    assert [r["p"] for r in got] == [True, False, None]


def test_recode_keeps_and_lookup_drops_unlisted(spark):
    v = F.col("v")
    got = rows(spark, ["a", "b", None], t.recode(v, {"a": "1"}).alias("r"), t.lookup(v, {"a": "1"}).alias("l"))
    assert [(r["r"], r["l"]) for r in got] == [("1", "1"), ("b", None), (None, None)]
