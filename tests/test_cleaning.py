import random

import pyarrow as pa
from pyspark.sql import functions as F

from doclens.functions import text as tx
from doclens.operators import cleaning, tokens

BITS = (
    "ml ai js ts cpp csharp postgres mongo k8s c++ c# .net react.js ci/cd python 3.11 2.7 java 17 tensorflow 2.x pytorch 1.13 react "
    "@ a@b.c http://x.y/z www.a.b é ß İ Σ ΑΣ ٣ ३ ５ 555-123-4567 555.1234567 5551234567 12 - . _ 日本 😀 Ⅷ ª the and x % ' no"
).split() + [" ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "́", "‍", "\x00", "�", "ͅ"]


def test_batches_are_cleaned_like_rows(spark):
    random.seed(5)
    texts = [None, "", " ", "ML", "٣", *("".join(random.choices(BITS, k=random.randint(1, 14))) for _ in range(4000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    stop = tx.default_stop_words()
    for keep in (True, False):
        done = cleaning.with_clean_text(df, F.col("t"), "a", keep_terms=keep).withColumn("b", tx.clean_text("t", keep))
        assert done.filter("a IS NULL OR a != b").take(3) == [] and done.count() == len(texts)
    done = cleaning.with_clean_text(df, F.col("t"), "a", stop_words=stop)
    rows = done.select("t", "a", tx.remove_stopwords(tx.clean_text("t"), folded=True).alias("b"))
    assert rows.filter("a IS NULL OR a != b").take(3) == []


def test_strip_cuts_what_the_pattern_calls_blank(spark):
    df = spark.range(0x10000).filter("id NOT BETWEEN 55296 AND 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    edge = df.select(F.concat(c, F.lit("x \n y"), c).alias("t"))
    plain = F.regexp_replace("t", rf"{tx.UNICODE}^\s+|\s+$", "")
    assert edge.filter(tx.strip("t") != plain).count() == 0


def test_preprocessing_cleans_batches_in_one_narrow_pass(spark):
    df = spark.createDataFrame([(1, "Skills\nC++, ML and the rest", "kept"), (2, None, None)], "doc_id long, resume_text string, other string")
    done = tokens.preprocess_documents(df)
    assert {r["doc_id"]: (r["cleaned_text"], r["other"]) for r in done.collect()} == {
        1: ("c machine learning rest c machine learning rest", "kept"), 2: ("", None),
    }
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_a_literal_is_looked_for_once_in_a_slice():
    texts = pa.array(["c", "", "++", "c++ c++", "x"])
    data, offsets = cleaning._bytes(texts)
    assert cleaning._holders(data, offsets, "c++") == [0, 3]  # the first one's match runs on into the next texts
    assert cleaning.clean(pa.array(["c", "++ a", "", "c++x c++y"])).to_pylist() == ["c", "a", "", "cpp x cpp y"]
