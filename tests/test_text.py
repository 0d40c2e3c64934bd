from pyspark.sql import functions as F

from mailfeat.functions.text import clean_text

GOLDEN = [
    ("Visit http://shop.example/a?b=1 or www.shop.example/c, 50% off", "visit"),
    ("Write to jo+x@mail.example.org <b>today</b>", "write today"),
    ("Weeeekly sooooo loud", "week soo loud"),
    ("its fyi", "it i for your informate"),
    ("im here, thx", "i am thank"),
    ("heeeello", "heello"),
    ("gr8 b4 4", ""),
    ("don't", "don"),
    ('<a href="http://e/x">click</a> now >', ""),
    (None, ""), ("", ""), ("   ", ""),
]


def test_cleaning_goldens(spark):
    df = spark.createDataFrame(GOLDEN, "text string, want string")
    got = df.select("want", clean_text(F.col("text")).alias("got")).collect()
    for r in got:
        assert r.got == r.want, (r.got, r.want)


def test_control_whitespace_splits(spark):
    df = spark.createDataFrame([("payment\x1cverification",)], "text string")
    assert df.select(clean_text(F.col("text"))).first()[0] == "payment verificate"
