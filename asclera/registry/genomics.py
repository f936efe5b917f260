"""Bindings: variants (VA) and single cells (SC)."""

from pyspark.sql import functions as F

from ..operators import neighbors, partitions
from ..plans import cells, variants
from . import query


def cell_counts(t):
    """Counts per order (cell) and part group (gene) with a batch and a label per cell."""
    k = F.col("l_partkey") % 60
    gene = F.when(k < 4, F.concat(F.lit("MT-"), k)).when(k < 9, F.concat(F.lit("RPL"), k)).when(k == 9, "HBA1").otherwise(F.concat(F.lit("G"), k))
    lines = t.lineitem.select(F.col("l_orderkey").alias("cell_id"), gene.alias("gene"), "l_quantity")
    # a cell's rows lie together, so that neither genes nor cells are shuffled again
    counts = partitions.dealt(lines, "cell_id").groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("count"))
    obs = counts.select("cell_id").distinct().select("cell_id", (F.col("cell_id") % 3).alias("batch"), (F.col("cell_id") % 7).alias("label"))
    return counts, obs


# ---- variants -------------------------------------------------------------------------


def sample_lines(t):
    """Variant lines from parts; every fourth has two alternative alleles."""
    k = F.col("p_partkey")
    line = F.concat_ws(
        "\t", F.concat(F.lit("chr"), k % 5 + 1), F.col("p_size").cast("string"), F.concat(F.lit("rs"), k), F.lit("A"),
        F.when(k % 4 == 0, "C,G").otherwise("T"), F.lit("50"), F.lit("PASS"), F.when(k % 6 == 0, ".").otherwise(F.concat(F.lit("DP="), "p_size")), F.lit("GT"),
    )
    return t.part.select(k.alias("line_no"), line.alias("value"))


def known_lines(t):
    """Reference lines from suppliers, same positions, with significance and frequencies."""
    k = F.col("s_suppkey")
    place = [(k % 5 + 1).cast("string"), (k % 50 + 1).cast("string"), F.lit("."), F.lit("A"), F.when(k % 2 == 0, "T").otherwise("C,G"), F.lit("."), F.lit(".")]
    significance = F.concat(F.lit("CLNSIG=S"), k, F.lit(";CLNDN=D"), k % 3, F.when(k % 3 == 0, "").otherwise(";CLNREVSTAT=reviewed"))
    frequency = F.concat(F.lit("AF="), F.when(k % 7 == 0, ".").otherwise((k / 4000000).cast("decimal(12,9)").cast("string")), F.when(k % 2 == 0, "").otherwise(",0.25"), F.lit(";nhomalt="), k % 4)
    tab = lambda info: F.concat_ws("\t", *place, info)
    return t.supplier.select(k.alias("line_no"), tab(significance).alias("cv"), tab(frequency).alias("gn"))


REFERENCE = """WITH r AS (SELECT s_suppkey AS k, (s_suppkey % 5 + 1) || ':' || (s_suppkey % 50 + 1) || ':A:' AS place, CASE WHEN s_suppkey % 2 = 0 THEN ['T'] ELSE ['C', 'G'] END AS alts FROM supplier),
    a AS (SELECT k, i - 1 AS alt_index, place || alts[i] AS key FROM r, (VALUES (1), (2)) v(i) WHERE i <= len(alts)),
    u AS (SELECT key, arg_max(k, k) AS k, arg_max(alt_index, k) AS alt_index FROM a GROUP BY 1),
    ref AS (SELECT key, 'S' || k AS clnsig, 'D' || (k % 3) AS clndn, CASE WHEN k % 3 = 0 THEN '' ELSE 'reviewed' END AS rev,
      CASE WHEN alt_index = 1 THEN 0.25::DOUBLE WHEN k % 7 = 0 THEN NULL ELSE (k / 4000000)::DECIMAL(12, 9)::DOUBLE END AS af, (k % 4)::VARCHAR AS hom FROM u)"""


def references(t):
    lines = known_lines(t)
    read = lambda c: variants.parse_lines(lines.select("line_no", F.col(c).alias("value")))
    return variants.significance_reference(read("cv")), variants.frequency_reference(read("gn"))


@query("VA-01", REFERENCE + 'SELECT key, clnsig AS "CLNSIG", clndn AS "CLNDN", rev AS "CLNREVSTAT", af AS "AF", hom AS nhomalt FROM ref')
def _(t):
    significance, frequency = references(t)
    return significance.join(frequency, "key").select("key", "CLNSIG", "CLNDN", "CLNREVSTAT", "AF", "nhomalt")


LINES = REFERENCE + """, l AS (SELECT p_partkey AS line_no, (p_partkey % 5 + 1) || ':' || p_size || ':A:' AS place, CASE WHEN p_partkey % 4 = 0 THEN ['C', 'G'] ELSE ['T'] END AS alts,
      CASE WHEN p_partkey % 6 = 0 THEN '.' ELSE 'DP=' || p_size END AS info FROM part),
    m AS (SELECT line_no, i AS alt_index, ref.* FROM l, (VALUES (1), (2)) v(i), ref WHERE i <= len(alts) AND ref.key = place || alts[i]),
    g AS (SELECT line_no, arg_max(clnsig, alt_index) AS sig, arg_max(clndn, alt_index) AS dn, arg_max(rev, alt_index) AS rev, arg_max(af, alt_index) FILTER (af IS NOT NULL) AS af, arg_max(hom, alt_index) AS hom FROM m GROUP BY 1)"""


def annotated(t):
    return variants.annotate(variants.parse_lines(sample_lines(t)), *references(t))


@query(
    "VA-02",
    LINES + """SELECT line_no, CASE WHEN sig IS NULL THEN l.info ELSE CASE WHEN l.info = '.' THEN '' ELSE l.info || ';' END || 'CLNSIG=' || sig || ';CLNDN=' || dn ||
       CASE WHEN rev = '' THEN '' ELSE ';CLNREVSTAT=' || rev END || CASE WHEN af IS NULL THEN '' ELSE ';gnomAD_AF=' || printf('%.6g', af) END || ';gnomAD_nhomalt=' || hom END AS new_info
       FROM l LEFT JOIN g USING (line_no)""",
)
def _(t):
    return variants.with_info(annotated(t)).select("line_no", "new_info")


@query("VA-03", LINES + "SELECT COUNT(sig) AS annotated, COUNT(*) AS total, ROUND(COUNT(sig) * 100.0 / COUNT(*), 1) AS rate_pct FROM l LEFT JOIN g USING (line_no)")
def _(t):
    return variants.annotation_rate(annotated(t))


@query(
    "VA-04",
    LINES + """SELECT 'chr' || (line_no % 5 + 1) AS chrom, p_size AS pos, 'A' AS ref, CASE WHEN line_no % 4 = 0 THEN 'C,G' ELSE 'T' END AS alt, 'rs' || line_no AS rsid,
       sig AS clinvar_sig, dn AS clinvar_disease, rev AS clinvar_review, af AS gnomad_af, hom::BIGINT AS gnomad_hom,
       NULL::VARCHAR AS gene_symbol, NULL::DOUBLE AS cadd_phred, NULL::VARCHAR AS sample_id FROM l JOIN part ON p_partkey = line_no LEFT JOIN g USING (line_no)""",
)
def _(t):
    """Annotated variants in the columns of the declared table; three of those that no source fills are compared."""
    names = ["chrom", "pos", "ref", "alt", "rsid", "clinvar_sig", "clinvar_disease", "clinvar_review", "gnomad_af", "gnomad_hom", "gene_symbol", "cadd_phred", "sample_id"]
    return variants.annotated_rows(annotated(t)).select(*names)


# ---- single cells ---------------------------------------------------------------------

CELLS = """WITH n AS (SELECT l_orderkey AS cell_id, l_partkey % 60 AS g, SUM(l_quantity) AS c FROM lineitem GROUP BY ALL),
    cc AS (SELECT cell_id, CASE WHEN g < 4 THEN 'MT-' || g WHEN g < 9 THEN 'RPL' || g WHEN g = 9 THEN 'HBA1' ELSE 'G' || g END AS gene, g, c AS count FROM n),
    obs AS (SELECT cell_id, SUM(count) AS total_counts, COUNT(*) AS n_genes_by_counts, 100.0 * SUM(CASE WHEN g < 4 THEN count ELSE 0 END) / SUM(count) AS pct_counts_mt,
      100.0 * SUM(CASE WHEN g BETWEEN 4 AND 8 THEN count ELSE 0 END) / SUM(count) AS pct_counts_ribo, 100.0 * SUM(CASE WHEN g = 9 THEN count ELSE 0 END) / SUM(count) AS pct_counts_hb FROM cc GROUP BY 1)"""


@query("SC-01", CELLS + "SELECT DISTINCT gene, g < 4 AS mt, g BETWEEN 4 AND 8 AS ribo, g = 9 AS hb FROM cc")
def _(t):
    return cells.gene_flags(cell_counts(t)[0].select("gene").distinct())


@query(
    "SC-02",
    CELLS + "SELECT cell_id, total_counts, n_genes_by_counts, ROUND(pct_counts_mt, 6) AS pct_counts_mt, ROUND(pct_counts_ribo, 6) AS pct_counts_ribo, ROUND(pct_counts_hb, 6) AS pct_counts_hb FROM obs",
)
def _(t):
    out = cells.cell_metrics(cell_counts(t)[0])
    return out.withColumns({c: F.round(c, 6) for c in ("pct_counts_mt", "pct_counts_ribo", "pct_counts_hb")})


@query(
    "SC-03",
    """WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m)
       SELECT event_id, value < m - 3 * d OR value > m + 3 * d AS outlier FROM events, m, d""",
)
def _(t):
    return cells.mad_outliers(t.events.select("event_id", "value"), "value", 3, "outlier").select("event_id", "outlier")


def bounds(metric, n):
    return f"""(SELECT MAX(m) - {n} * median(abs({metric} - m)) AS lo, MAX(m) + {n} * median(abs({metric} - m)) AS hi FROM obs, (SELECT median({metric}) AS m FROM obs))"""


@query(
    "SC-04",
    CELLS + f"""SELECT cell_id, NOT (total_counts < a.lo OR total_counts > a.hi OR n_genes_by_counts < b.lo OR n_genes_by_counts > b.hi OR pct_counts_mt < c.lo OR pct_counts_mt > c.hi OR pct_counts_mt > 8.0) AS pass_qc
       FROM obs, {bounds('total_counts', 5)} a, {bounds('n_genes_by_counts', 5)} b, {bounds('pct_counts_mt', 3)} c""",
)
def _(t):
    return cells.pass_flags(cells.cell_metrics(cell_counts(t)[0])).select("cell_id", "pass_qc")


@query("SC-05", CELLS + "SELECT gene, COUNT(*) AS cells, SUM(count) AS counts FROM cc GROUP BY 1 HAVING COUNT(*) >= 900 AND SUM(count) >= 24000")
def _(t):
    kept = cells.keep_genes(cell_counts(t)[0], 900, 24000)
    return kept.groupBy("gene").agg(F.count("*").alias("cells"), F.sum("count").alias("counts"))


@query(
    "SC-06",
    CELLS + """SELECT 'before' AS label, COUNT(*) AS cells, 60::BIGINT AS genes, ROUND(AVG(total_counts), 6) AS mean_counts, median(total_counts)::DOUBLE AS median_counts, ROUND(AVG(n_genes_by_counts), 6) AS mean_genes,
       median(n_genes_by_counts)::DOUBLE AS median_genes, ROUND(AVG(pct_counts_mt), 6) AS mean_mt_pct, ROUND(AVG(pct_counts_ribo), 6) AS mean_ribo_pct FROM obs""",
)
def _(t):
    counts, _obs = cell_counts(t)
    out = cells.summary(cells.cell_metrics(counts), counts, "before")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_counts", "mean_genes", "mean_mt_pct", "mean_ribo_pct")})


@query(
    "SC-07",
    CELLS + "SELECT cc.cell_id, gene, ROUND(ln(1 + count * 10000 / total_counts), 6) AS value FROM cc JOIN obs USING (cell_id)",
)
def _(t):
    return cells.normalize(cell_counts(t)[0]).select("cell_id", "gene", F.round("value", 6).alias("value"))


@query(
    "SC-08",
    """WITH n AS (SELECT l_orderkey AS cell, l_partkey % 60 AS g, SUM(l_quantity) AS c FROM lineitem GROUP BY ALL), t AS (SELECT cell, SUM(c) AS tot FROM n GROUP BY 1),
       x AS (SELECT  CASE WHEN g < 4 THEN 'MT-' || g WHEN g < 9 THEN 'RPL' || g WHEN g = 9 THEN 'HBA1' ELSE 'G' || g END AS gene, c * 10000 / tot AS v FROM n JOIN t USING (cell)),
       z AS (SELECT  COUNT(*) AS n FROM t ),
       m AS (SELECT  gene, SUM(v) / ANY_VALUE(z.n) AS mean, (SUM(v * v) - SUM(v) * SUM(v) / ANY_VALUE(z.n)) / (ANY_VALUE(z.n) - 1) AS var FROM x , z GROUP BY ALL),
       d AS (SELECT *, ln(greatest(var / mean, 1e-12)) AS dispersion, ln(1 + mean) AS lv FROM m WHERE mean > 0),
       s AS (SELECT  MIN(lv) AS lo, MAX(lv) AS hi FROM d ), p AS (SELECT d.*, least(floor(COALESCE((lv - lo) / nullif(hi - lo, 0), 0) * 20), 19) AS bin FROM d , s),
       q AS (SELECT  bin, AVG(dispersion) AS am, STDDEV(dispersion) AS sd FROM p GROUP BY ALL),
       r AS (SELECT p.*, ROUND(COALESCE((dispersion - am) / nullif(sd, 0), 1.0), 9) AS score FROM p JOIN q USING ( bin))
       SELECT gene, ROUND(mean, 6) AS mean, ROUND(dispersion, 6) AS dispersion, ROUND(score, 6) AS score FROM r ORDER BY r.score DESC, gene LIMIT 20""",
)
def _(t):
    out = cells.variable_genes(cell_counts(t)[0], n=20)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "dispersion", "score")})


@query(
    "SC-08-batch",
    """WITH n AS (SELECT l_orderkey AS cell, l_partkey % 60 AS g, SUM(l_quantity) AS c FROM lineitem GROUP BY ALL), t AS (SELECT cell, SUM(c) AS tot FROM n GROUP BY 1),
       x AS (SELECT cell % 3 AS batch, CASE WHEN g < 4 THEN 'MT-' || g WHEN g < 9 THEN 'RPL' || g WHEN g = 9 THEN 'HBA1' ELSE 'G' || g END AS gene, c * 10000 / tot AS v FROM n JOIN t USING (cell)),
       z AS (SELECT cell % 3 AS batch, COUNT(*) AS n FROM t GROUP BY 1),
       m AS (SELECT batch, gene, SUM(v) / ANY_VALUE(z.n) AS mean, (SUM(v * v) - SUM(v) * SUM(v) / ANY_VALUE(z.n)) / (ANY_VALUE(z.n) - 1) AS var FROM x JOIN z USING (batch) GROUP BY ALL),
       d AS (SELECT *, ln(greatest(var / mean, 1e-12)) AS dispersion, ln(1 + mean) AS lv FROM m WHERE mean > 0),
       s AS (SELECT batch, MIN(lv) AS lo, MAX(lv) AS hi FROM d GROUP BY 1), p AS (SELECT d.*, least(floor(COALESCE((lv - lo) / nullif(hi - lo, 0), 0) * 20), 19) AS bin FROM d JOIN s USING (batch)),
       q AS (SELECT batch, bin, AVG(dispersion) AS am, STDDEV(dispersion) AS sd FROM p GROUP BY ALL),
       r AS (SELECT p.*, ROUND(COALESCE((dispersion - am) / nullif(sd, 0), 1.0), 9) AS score FROM p JOIN q USING (batch, bin)),
       k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch ORDER BY score DESC, gene) AS rank FROM r)
       SELECT gene, COUNT(*) FILTER (rank <= 20) AS batches, median(rank)::DOUBLE AS median_rank FROM k GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 20""",
)
def _(t):
    counts, obs = cell_counts(t)
    return cells.variable_genes(counts.join(obs.select("cell_id", "batch"), "cell_id"), n=20, batch="batch")


@query("SC-09")
def _(t):
    """Markers per label; counts of genes G3x are raised in the cells of label 0."""
    counts, obs = cell_counts(t)
    raised = F.startswith("gene", F.lit("G3")) & (F.col("label") == 0)
    lifted = counts.join(obs, "cell_id").withColumn("count", F.when(raised, F.col("count") * 60).otherwise(F.col("count")))
    return cells.marker_genes(cells.normalize(lifted.select("cell_id", "gene", "count")), obs, "label", 10)


@query(
    "SC-10",
    """WITH d AS (SELECT a.vec_id AS id, a.label AS la, b.label AS lb, a.vec_id % 3 AS ba, b.vec_id % 3 AS bb,
         list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2 FROM embeddings a, embeddings b),
       l AS (SELECT id, la = lb AS own, SUM(d2) AS sm, COUNT(*) AS cnt FROM d GROUP BY id, la, lb), g AS (SELECT id, ba = bb AS own, SUM(d2) AS sm, COUNT(*) AS cnt FROM d GROUP BY id, ba, bb),
       s1 AS (SELECT s FROM (SELECT AVG((b - a) / greatest(a, b)) AS s FROM (SELECT id, MAX(CASE WHEN own THEN sm / nullif(cnt - 1, 0) END) AS a, MIN(CASE WHEN NOT own THEN sm / cnt END) AS b FROM l GROUP BY 1))), s2 AS (SELECT s FROM (SELECT AVG((b - a) / greatest(a, b)) AS s FROM (SELECT id, MAX(CASE WHEN own THEN sm / nullif(cnt - 1, 0) END) AS a, MIN(CASE WHEN NOT own THEN sm / cnt END) AS b FROM g GROUP BY 1)))
       SELECT (SELECT COUNT(*) FROM embeddings) AS points, ROUND(s1.s, 6) AS silhouette_label, ROUND(s2.s, 6) AS silhouette_batch, ROUND(s1.s - s2.s, 6) AS integration_score FROM s1, s2""",
)
def _(t):
    from ..plans import models

    out = models.silhouettes(t.embeddings, "embedding", {"label": F.col("label"), "batch": F.col("vec_id") % 3})
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "points"})


@query(
    "SC-11",
    """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
         FROM embeddings a, embeddings b),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d2, b) AS rn FROM d),
       p AS (SELECT a, COUNT(DISTINCT b % 10) / 10.0 AS seen FROM r WHERE rn <= 15 GROUP BY 1)
       SELECT ROUND(AVG(seen), 6) AS batch_mixing, COUNT(*) AS points FROM p""",
)
def _(t):
    rows = t.embeddings.select("vec_id", "embedding", (F.col("vec_id") % 10).alias("batch"))
    out = neighbors.batch_mixing(rows, "vec_id", "embedding", "batch", 15)
    return out.withColumn("batch_mixing", F.round("batch_mixing", 6))


@query(
    "SC-11-graph",
    """SELECT (SELECT COUNT(*) FROM embeddings) AS points, (SELECT COUNT(*) FROM embeddings) * LEAST(15, (SELECT COUNT(*) FROM embeddings)) AS edges,
       COUNT(*) AS queries, TRUE AS recall_reached FROM embeddings WHERE vec_id % 100 = 0""",
)
def _(t):
    """The neighbour graph of all points; its recall is measured for every hundredth id against all points."""
    rows = t.embeddings.select("vec_id", "embedding")
    found = neighbors.graph(rows, "vec_id", "embedding", 15)
    exact = neighbors.nearest(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 15)
    sizes = found.agg(F.count_distinct("vec_id").alias("points"), F.count("*").alias("edges"))
    measured = neighbors.recall(found, exact, "vec_id").first()  # one row
    return sizes.withColumns({"queries": F.lit(measured["queries"]).cast("bigint"), "recall_reached": F.lit(measured["recall"] >= 0.95)})


@query("SC-12")
def _(t):
    from ..plans import models

    return models.clusters(t.embeddings, "embedding", 8).groupBy("cluster").agg(F.count("*").alias("cells"))


@query(
    "SC-13",
    """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS lab, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2
         FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d2, b) AS rn FROM d),
       v AS (SELECT a, lab, COUNT(*) AS n FROM r WHERE rn <= 15 GROUP BY ALL)
       SELECT a AS vec_id, arg_max(lab, n * 100000 - lab)::BIGINT AS predicted, ROUND(MAX(n) / SUM(n), 6) AS confidence, ROUND(MAX(n) / SUM(n), 6) >= 0.5 AS confident FROM v GROUP BY 1""",
)
def _(t):
    """Each point is labelled by its neighbours, itself left out."""
    found = neighbors.vote(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 15, include_self=False)
    return cells.accepted_labels(found.withColumn("confidence", F.round("confidence", 6)))
