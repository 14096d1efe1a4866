"""The engine's relations, derived from the driver's tables so that every operator has input at any scale.

Each relation comes twice: as a DataFrame and as a DuckDB common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_LABEL = -1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contour_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag_id, image_id, k, y, x): a star-shaped outline for each vector, about 100 px in radius."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frag_id"), F.col("label").alias("image_id"), F.posexplode("embedding").alias("k", "e"))
    r = 100.0 * (1.0 + F.col("e").cast("double"))
    turn = 2.0 * F.pi() * F.col("k") / 64
    return t.select("frag_id", "image_id", "k", F.round(r * F.sin(turn), 6).alias("y"), F.round(r * F.cos(turn), 6).alias("x"))


def raster_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, alpha, v): an 8 x 8 picture for each vector, about half of it opaque."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "e"))
    return t.select("image_id", F.expr("CAST(k div 8 AS INT)").alias("y"), (F.col("k") % 8).alias("x"), F.when(F.col("e") > 0, 255).otherwise(0).alias("alpha"), F.floor(F.abs(F.col("e").cast("double")) * 1000).cast("int").alias("v"))


def patch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch scores: 20 pairs, two sides, 40 translations each."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("pair_id"), F.when(F.col("l_linestatus") == "O", "recto").otherwise("verso").alias("side"), (F.col("l_partkey") % 40).cast("int").alias("translation_id"), "l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.col("l_discount") * 10, 4).alias("score"))
    order = Window.partitionBy("pair_id", "side", "translation_id").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    tid, pair = F.col("translation_id").cast("double"), F.col("pair_id").cast("double")
    return t.select("pair_id", "side", "translation_id", (F.row_number().over(order) - 1).alias("patch_idx"), "score", F.round(100.0 * F.sin(tid * 1.7 + pair), 6).alias("ty"), F.round(100.0 * F.cos(tid * 2.3 + pair), 6).alias("tx"))


def pictures(ranges: DataFrame) -> DataFrame:
    """Grid sizes of the pairs' pictures: a height of 64 (4 + pair mod 3) px and a width of 64 (5 + pair mod 4) px."""
    from fragloom.operators.merge import grid_size

    ny, nx = grid_size(64 * (4 + F.col("pair_id") % 3), 64 * (5 + F.col("pair_id") % 4))
    return ranges.withColumns({"ny": ny, "nx": nx})


def scored_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, logit, batch): labels with a made-up logit."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return t.select("doc_id", F.col("quality").alias("y"), F.round((F.col("n_chars") % 1000) / 250.0 - 2.0, 6).alias("logit"), (F.col("doc_id") % 7).alias("batch"))


def image_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, stem): images of folders; a quarter show several fragments."""
    stem = F.concat(F.col("p_name"), F.lit("-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 4 == 0, "+B").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("dir"), stem.alias("stem"))


CLASSES = ("pos", "neg", "pos_synth", "pos_synth", "neg_synth", "neg_synth")


def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class): samples in the mixture of a batch."""
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), name.alias("class"))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.nullif((F.col("o_custkey") % 4).cast("int"), F.lit(0)).alias("pad"), F.col("o_orderstatus").alias("split"))
    return t.groupBy("kind", "pad", "split").agg(F.count("*").alias("samples"))


def colour_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, colour): a pixel for each line item, about 50 colours a picture."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("img"), F.col("l_quantity").cast("int").alias("colour"))


def raster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag_id, side, data, height, width, n_channels, status): the pictures of ``raster_px`` in BGRA bytes, colour v mod 256; every 17th cannot be read."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            e = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, 64)
            grey = (np.floor(np.abs(e) * 1000).astype(np.int64) % 256).astype(np.uint8)
            data = np.stack([grey, grey, grey, np.where(e > 0, 255, 0).astype(np.uint8)], axis=2)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([p.tobytes() for p in data], pa.binary())], ["frag_id", "data"])

    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "frag_id long, data binary")
    size = {c: F.lit(n) for c, n in (("height", 8), ("width", 8), ("n_channels", 4))}
    return t.withColumns({"side": F.lit("recto"), **size, "status": F.when(F.col("frag_id") % 17 == 0, "corrupt").otherwise("ok")})


def raster_contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, side) of pictures that follow each other, and four poses of each with one contact; every 13th pair has no pose."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(ids.select(F.col("vec_id").alias("b")), "b").select("a", "b", F.lit("recto").alias("side"))
    t = pairs.where("a % 13 <> 0").withColumn("translation_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    moved = {"ty": (F.col("translation_id") * 3 - 4 + F.col("a") % 3).cast("double"), "tx": (F.col("translation_id") * 2 - 3 - F.col("b") % 2).cast("double")}
    return pairs, t.withColumns({"patch_idx": F.lit(0), **moved, **{c: F.lit(4.0) for c in ("py", "px", "qy", "qx")}})


SQL = {
    "cp": "cp AS (SELECT frag_id, image_id, k, round(100.0::DOUBLE * (1 + e) * sin(2 * pi() * k / 64), 6) AS y, round(100.0::DOUBLE * (1 + e) * cos(2 * pi() * k / 64), 6) AS x FROM (SELECT vec_id AS frag_id, label AS image_id, unnest(range(0, len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS e FROM embeddings))",
    "px": "px AS (SELECT image_id, (k // 8)::INT AS y, (k % 8)::INT AS x, CASE WHEN e > 0 THEN 255 ELSE 0 END AS alpha, floor(abs(e) * 1000)::INT AS v FROM (SELECT vec_id AS image_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::DOUBLE AS e FROM embeddings))",
    "ps": "ps AS (SELECT pair_id, side, translation_id, row_number() OVER (PARTITION BY pair_id, side, translation_id ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS patch_idx, score, round(100.0::DOUBLE * sin(translation_id::DOUBLE * 1.7::DOUBLE + pair_id::DOUBLE), 6) AS ty, round(100.0::DOUBLE * cos(translation_id::DOUBLE * 2.3::DOUBLE + pair_id::DOUBLE), 6) AS tx FROM (SELECT l_suppkey % 20 AS pair_id, CASE WHEN l_linestatus = 'O' THEN 'recto' ELSE 'verso' END AS side, (l_partkey % 40)::INT AS translation_id, l_orderkey, l_linenumber, l_extendedprice, round(l_discount * 10, 4) AS score FROM lineitem))",
    "tm": "tm AS (SELECT pair_id, side, translation_id, avg(score) AS score, arg_min(ty, patch_idx) AS ty, arg_min(tx, patch_idx) AS tx FROM ps GROUP BY ALL)",
    "bd": "bd AS (SELECT pair_id, (4 + pair_id % 3)::INT AS ny, (5 + pair_id % 4)::INT AS nx, y0, CASE WHEN y1 = y0 THEN y1 + 1e-6 ELSE y1 END AS y1, x0, CASE WHEN x1 = x0 THEN x1 + 1e-6 ELSE x1 END AS x1 FROM (SELECT pair_id, min(ty) AS y0, max(ty) AS y1, min(tx) AS x0, max(tx) AS x1 FROM tm GROUP BY pair_id))",
    "cell": "cell AS (SELECT pair_id, ny, nx, iy, ix, y0 + iy * ((y1 - y0) / (ny - 1)) AS gy, x0 + ix * ((x1 - x0) / (nx - 1)) AS gx FROM (SELECT *, unnest(range(0, nx))::INT AS ix FROM (SELECT *, unnest(range(0, ny))::INT AS iy FROM bd)))",
    # Delaunay triangles by their definition: no other translation lies within the circumcircle
    "tri": "p AS (SELECT pair_id, side, ty AS y, tx AS x, min(translation_id) AS i, arg_min(score, translation_id) AS s FROM tm GROUP BY ALL), "
    "t3 AS (SELECT a.pair_id, a.side, a.i AS i, b.i AS j, c.i AS k, a.y AS ay, a.x AS ax, a.s AS sa, b.y AS by_, b.x AS bx, b.s AS sb, c.y AS cy, c.x AS cx, c.s AS sc, (b.y - a.y) * (c.x - a.x) - (b.x - a.x) * (c.y - a.y) AS det FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.side = b.side AND a.i < b.i JOIN p c ON a.pair_id = c.pair_id AND a.side = c.side AND b.i < c.i), "
    "ci AS (SELECT *, ((cx - ax) * ((by_ - ay) ** 2 + (bx - ax) ** 2) - (bx - ax) * ((cy - ay) ** 2 + (cx - ax) ** 2)) / (2 * det) AS oy, ((by_ - ay) * ((cy - ay) ** 2 + (cx - ax) ** 2) - (cy - ay) * ((by_ - ay) ** 2 + (bx - ax) ** 2)) / (2 * det) AS ox FROM t3 WHERE det <> 0), "
    "tri AS (SELECT * FROM ci WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pair_id = ci.pair_id AND p.side = ci.side AND p.i NOT IN (ci.i, ci.j, ci.k) AND (p.y - ay - oy) ** 2 + (p.x - ax - ox) ** 2 < (oy * oy + ox * ox) * (1 - 1e-12)))",
    "ip": "bary AS (SELECT c.pair_id, t.side, c.iy, c.ix, ((c.gy - ay) * (cx - ax) - (c.gx - ax) * (cy - ay)) / det AS u, ((by_ - ay) * (c.gx - ax) - (bx - ax) * (c.gy - ay)) / det AS v, sa, sb, sc FROM cell c JOIN tri t ON c.pair_id = t.pair_id), "
    "ip AS (SELECT c.pair_id, c.side, c.ny, c.nx, c.iy, c.ix, c.gy, c.gx, coalesce(s, 0) AS s FROM (SELECT cell.*, side FROM cell JOIN (SELECT DISTINCT pair_id, side FROM tm) USING (pair_id)) c LEFT JOIN (SELECT pair_id, side, iy, ix, min((1 - u - v) * sa + u * sb + v * sc) AS s FROM bary WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 GROUP BY ALL) b ON c.pair_id = b.pair_id AND c.side = b.side AND c.iy = b.iy AND c.ix = b.ix)",
    "mc": "mc AS (SELECT c.pair_id, c.ny, c.nx, c.iy, c.ix, c.gy, c.gx, coalesce(r.s, 0) AS s_recto, coalesce(v.s, 0) AS s_verso, coalesce(r.s, 0) + coalesce(v.s, 0) AS s_sum FROM cell c LEFT JOIN ip r ON r.side = 'recto' AND r.pair_id = c.pair_id AND r.iy = c.iy AND r.ix = c.ix LEFT JOIN ip v ON v.side = 'verso' AND v.pair_id = c.pair_id AND v.iy = c.iy AND v.ix = c.nx - 1 - c.ix)",
    "sl": "sl AS (SELECT l.doc_id, quality AS y, round((n_chars % 1000) / 250.0::DOUBLE - 2, 6) AS logit, l.doc_id % 7 AS batch FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "ic": "ic AS (SELECT p_type AS dir, p_name || '-' || p_partkey || CASE WHEN p_size % 4 = 0 THEN '+B' ELSE '' END AS stem FROM part)",
    "cs": "cs AS (SELECT event_id AS id, ['pos', 'neg', 'pos_synth', 'pos_synth', 'neg_synth', 'neg_synth'][event_id % 6 + 1] AS class FROM events)",
    "ds": "ds AS (SELECT o_orderpriority AS kind, nullif((o_custkey % 4)::INT, 0) AS pad, o_orderstatus AS split, count(*) AS samples FROM orders GROUP BY ALL)",
    "cent": "cent AS (SELECT frag_id, sum((y + y1) * c) / (3 * sum(c)) AS cy, sum((x + x1) * c) / (3 * sum(c)) AS cx FROM (SELECT *, x * y1 - x1 * y AS c FROM (SELECT *, coalesce(lead(y) OVER w, first(y) OVER w) AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x1 FROM cp WINDOW w AS (PARTITION BY frag_id ORDER BY k))) GROUP BY frag_id)",
    "arc": "arc AS (SELECT *, lag(cum) OVER (PARTITION BY frag_id ORDER BY k) AS prev FROM (SELECT *, sum(step) OVER (PARTITION BY frag_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, coalesce(sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2), 0) AS step FROM cp WHERE k % 3 = 0 WINDOW w AS (PARTITION BY frag_id ORDER BY k))))",
    "sm": "tot AS (SELECT frag_id, floor(max(cum))::INT AS total FROM arc GROUP BY frag_id), want AS (SELECT frag_id, unnest(range(0, total, 100)) AS far FROM tot), sm AS (SELECT arc.frag_id, any_value(image_id) AS image_id, (far // 100)::INT AS m, min(k)::INT AS k, arg_min(y, k) AS y, arg_min(x, k) AS x FROM arc JOIN want ON arc.frag_id = want.frag_id AND cum >= far GROUP BY arc.frag_id, far)",
    "pr": "fr AS (SELECT DISTINCT frag_id, image_id FROM cp), pr AS (SELECT f.image_id, f.frag_id AS a, g.frag_id AS b FROM fr f JOIN fr g ON f.image_id = g.image_id AND f.frag_id < g.frag_id)",
    "cd": "cd AS (SELECT *, ay - by_ + 20 * dy AS ty, ax - bx + 20 * dx AS tx FROM (SELECT *, uy / sqrt(uy * uy + ux * ux) AS dy, ux / sqrt(uy * uy + ux * ux) AS dx FROM (SELECT pr.a, pr.b, s.m AS ia, t.m AS ib, s.y AS ay, s.x AS ax, t.y AS by_, t.x AS bx, d.cy + s.y - t.y - c.cy AS uy, d.cx + s.x - t.x - c.cx AS ux FROM pr JOIN cent c ON c.frag_id = pr.a JOIN cent d ON d.frag_id = pr.b JOIN sm s ON s.frag_id = pr.a JOIN sm t ON t.frag_id = pr.b)))",
}


def sql(*names: str, body: str) -> str:
    """A query over the named relations, in the order given."""
    return f"WITH {', '.join(SQL[n] for n in names)} {body}"
