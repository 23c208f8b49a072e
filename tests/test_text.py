from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import signal as sig
from resona.functions import text as tx
from resona.operators import chunking
from resona.operators import ingestion as ing


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("v")).first()[0]


def test_negation(spark):
    t = F.col("t")
    no = lambda text, term: one(spark, tx.negated(t, term), text)
    assert no("outer race fault, inner race değil", "inner race")
    assert not no("inner race değil, outer race fault", "outer race")
    assert not no("inner race değil ancak Outer Race", "outer race")
    assert no("Outer Race a b c d e f yok", "outer race")  # among the last three words
    assert no("outer race a b yok c d e f", "outer race") and not no("outer race a b c d e f yok g h i", "outer race")
    assert no("the outer race is in contrast to x y z", "outer race")
    assert not no("outer-race yok", "outer race") and not no("", "x") and not no(None, "x")
    assert one(spark, tx.affirmed(t, tx.terms(["kafes"])), "Kafes yok. Kafes!") and not one(spark, tx.affirmed(t, tx.terms(["kafes"])), "Kafes yok")


def test_consistency(spark):
    from resona.operators.evaluation import consistency

    def of(text, fault, zone):
        return tuple(spark.createDataFrame([(text, fault, zone)], "t string, f string, z string").select(consistency(F.col("t"), F.col("f"), F.col("z")).alias("c")).first()["c"])

    assert of("outer race seen", "inner (bpfi)", None) == (True, False, False)
    assert of("outer race yok", "inner (bpfi)", "Zone A") == (False, False, True)
    assert of("bpfi değil", "bpfi", "Zone A") == (True, False, False)
    assert of("misalignment", "looseness", "Zone A") == (False, False, True)
    assert of("now Zone C.", "unbalance", "Zone A") == (False, True, False) and of("zone c değil", None, "Zone A") == (False, False, True)


def test_columns(spark):
    t = F.col("t")
    assert one(spark, tx.fold_turkish(t), "İĞI") == "iğı"
    assert one(spark, tx.ascii_turkish(t), "ŞİIÇ") == "siic"
    assert one(spark, tx.query_weights(t)["sparse"], "limits of iso 10816 here") == 0.8
    assert one(spark, tx.expand(t), "looseness") == "looseness (mekanik gevşeklik, 0.5X alt harmonik, structural looseness)"
    thoughts = {
        "<think>a</think> b": "b", "x <think>a</think> b</think> c ": "b</think> c", "x <think>a</think> \n": "x <think>a</think>", " plain\n": "plain", "said <think>never": "said",
        '<think>he said "the first answer" and "the second one" end': "the second one", "<think>one\n two \n- list\n# head\n3. item": "two", "<think>": "<think>", "<think>* a": "<think>* a",
    }
    for said, answer in thoughts.items():
        assert one(spark, tx.without_thoughts(t), said) == answer
    assert one(spark, tx.affirmed(t, tx.terms(["outer race"])), "No outer race. Outer race seen") is True
    assert one(spark, tx.denied(t, tx.terms(["kafes"])), None) in (False, None)
    assert one(spark, sig.machine_class(t), "class_2") == "Class II" and one(spark, sig.machine_class(t), "five") is None
    assert tuple(one(spark, sig.parse_range(t), "2,500 – ... RPM")) == (2500.0, float("inf"))
    assert one(spark, sig.multipliers(t), "are 1x and 2xRPM") == [1.0, 2.0]


def test_split_text():
    text = "aa bb. " * 40
    parts = chunking.split(text, 12, 2)
    assert all(len(p) <= 12 * 7 for p in parts) and parts[0].startswith("aa")
    assert chunking.split("x" * 120, 50) == ["x" * 50, "x" * 50, "x" * 20]
    assert chunking.split(" ", 50) == []


def test_masks_and_tables(spark):
    blocks = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 20.0, 0.0, 30.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 6.0)], blocks.schema)
    assert [r.x0 for r in ing.masked(blocks, boxes).collect()] == [20.0]
    rows = spark.createDataFrame([([["a", "b"], ["1", None]],)], "rows array<array<string>>")
    q = rows.select(ing.table_quality(F.col("rows")).alias("q")).first()["q"]
    assert (q.cells, q.filled, q.ghost, q.reliable) == (4, 3, False, False)


def test_records(spark):
    import uuid

    from resona.functions import records as rec

    t = F.col("t")
    assert one(spark, rec.uuid5(t), "é_child_1") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "é_child_1"))
    assert one(spark, rec.uuid5(t), str(uuid.NAMESPACE_URL)) == str(uuid.NAMESPACE_URL)
    assert one(spark, rec.order_number(t), "0.5X") == 0.5 and one(spark, rec.order_number(t), "X") is None
    assert one(spark, rec.harmonics(F.lit(2.0), 3)) == [2.0, 4.0, 6.0]
    assert one(spark, rec.markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(t, F.lit(None).cast("string")))), "x\ny") == "| a | b |\n| --- | --- |\n| x y |  |"
    assert one(spark, F.variant_get(rec.first_json(t), "$.a", "int"), 'so ```json\n{"a": 3}\n``` ok') == 3
