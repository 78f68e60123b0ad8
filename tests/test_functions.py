from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.ontology import canonical_relation


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_fold_key(spark):
    assert one(spark, "  Đường  Trường-Sơn! ß", X.fold_key) == "duong truong son ss"
    assert one(spark, None, X.fold_key) == ""


def test_years_stand_alone(spark):
    assert one(spark, "In 1954, 1954 and 2101 or 19541, 2024.", X.years) == [1954, 1954, 2024]


def test_heading(spark):
    assert one(spark, "CHAPTER ONE\nbody text follows here.", X.heading) == "CHAPTER ONE"
    assert one(spark, "Just a sentence.\nAnother one.", X.heading) == ""
    assert one(spark, "ALONE", X.heading) == ""


def test_canonical_id_ignores_accents_and_case(spark):
    f = lambda x: X.canonical_id(F.lit("PERSON"), x)
    assert one(spark, "Võ Nguyên Giáp", f) == one(spark, "vo nguyen GIAP", f)
    assert one(spark, "x", f) != one(spark, "x", lambda x: X.canonical_id(F.lit("EVENT"), x))


def test_display_date(spark):
    assert one(spark, "1901-03-02", X.display_date) == "2/3/1901"
    assert one(spark, "spring 1901", X.display_date) == "spring 1901"


def test_relations(spark):
    cases = {"Thành lập": "FOUNDED", "part_of": "PART_OF", "được chỉ huy bởi": "COMMANDED", "hợp tác": "RELATED_TO", "dẫn đến": "RESULTED_IN", "": "RELATED_TO"}
    for raw, want in cases.items():
        assert one(spark, raw, canonical_relation) == want


def test_facets_keep_the_taxonomys_order(spark):
    f = lambda x: X.facets(x, {"b": ["moc"], "a": ["tran danh"]})
    assert one(spark, "Trận đánh và mốc", f) == ["b", "a"]


def test_grams_and_dice(spark):
    assert one(spark, "a b c", lambda x: X.grams(F.split(x, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda x: X.grams(F.split(x, " "), 2)) == []
    assert one(spark, "a b", lambda x: X.dice(F.split(x, " "), F.array(F.lit("b"), F.lit("c")))) == 0.5
