"""What the findings of round 3 were about, on small tables."""

import hashlib

from pyspark.sql import functions as F

from trekmill.functions import geo, text
from trekmill.operators import relational


def test_digest_of_block_digests_whatever_the_number_of_blocks(spark):
    got = relational.stream_digest(spark.range(50), ["id"], F.concat(F.lit("r"), "id"), block=3).collect()
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert [r.digest for r in got] == [sha(sha(f"r{k}" for k in range(n, min(n + 3, 50))) for n in range(0, 50, 3))]
    assert relational.stream_digest(spark.range(0), ["id"], F.col("id").cast("string")).first().digest == sha([])


def test_area_of_a_small_ring_far_from_the_origin_keeps_its_digits(spark):
    w, s, e, n = 10.123457, 43.654321, 10.123457 + 1e-4, 43.654321 + 1e-4
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in ((s, w), (s, e), (n, e), (n, w))))
    got = spark.range(1).select(geo.ring_area(ring).alias("a"), geo.ring_area(F.slice(ring, 1, 0)).alias("none")).first()
    assert got.a == (e - w) * (n - s) and got.none == 0


def test_every_paragraph_is_trimmed_of_spaces_only(spark):
    found = spark.range(1).select(text.paragraphs(F.lit(" 0 a 0 \n1 b 1\n 2\n 12 c\n4"), 1).alias("p")).first().p
    assert found == ["0 a 0", "1 b 1", "2", "12 c", "4"]
