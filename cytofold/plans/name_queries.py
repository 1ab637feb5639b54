"""Queries for names, ids, labels and other scalar logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofold.functions import names as N
from cytofold.operators import aggregate as A
from cytofold.plans.registry import Registry, rounded
from cytofold.plans.stand_in import table

query = Registry()


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN (o_orderstatus || '/1/0') || '_' || o_custkey
    WHEN o_orderkey % 2 = 0 THEN (o_orderstatus || '/1/0') || '_cp' || o_orderkey ELSE '' END AS cell_id FROM orders"""
)
def p01_cell_id(spark, sf_dir):
    seg = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    other = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.cell_id(F.concat("o_orderstatus", F.lit("/1/0")), seg, other).alias("cell_id"))


@query(
    """WITH l AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN NULL WHEN 3 THEN 'nan' ELSE c_name END AS label FROM customer)
    SELECT c_custkey, coalesce(label NOT IN ('', 'None'), false) AS valid, CASE WHEN label IN ('', 'None', 'nan') THEN NULL ELSE label END AS cleaned FROM l"""
)
def p02_valid_label(spark, sf_dir):
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, "").when(k == 1, "None").when(k == 2, None).when(k == 3, "nan").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return rows.select("c_custkey", N.is_valid_label(F.col("label")).alias("valid"), N.clean_str(F.col("label")).alias("cleaned"))


@query(
    """WITH g AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ntc' ELSE c_mktsegment END AS gene, CASE c_custkey % 7 WHEN 0 THEN -1 ELSE c_custkey END AS ncbi FROM customer)
    SELECT c_custkey, CASE WHEN ncbi = -1 THEN 'NTC' ELSE gene END AS by_id, CASE WHEN gene IS NULL OR upper(gene) = 'NTC' THEN 'NTC' ELSE gene END AS by_name FROM g"""
)
def p05_control_labels(spark, sf_dir):
    gene = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_custkey") % 4 == 1, "ntc").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", gene.alias("gene"), F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_custkey")).alias("ncbi"))
    return rows.select("c_custkey", N.control_by_id(F.col("gene"), F.col("ncbi")).alias("by_id"), N.control_by_name(F.col("gene")).alias("by_name"))


@query(
    """WITH b AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(' || p_size || ', 2, ' || p_partkey || ', 4)' WHEN 1 THEN '[1 2 3]' END AS bbox FROM part),
    n AS (SELECT p_partkey, regexp_extract_all(bbox, '-?\\d+') AS v FROM b)
    SELECT p_partkey, CASE WHEN len(v) = 4 THEN v[1]::INTEGER END AS y0, CASE WHEN len(v) = 4 THEN v[3]::INTEGER END AS y1 FROM n"""
)
def p06_parse_bbox(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", 2, "), F.col("p_partkey").cast("string"), F.lit(", 4)"))).when(F.col("p_partkey") % 3 == 1, "[1 2 3]")
    rows = table(spark, sf_dir, "part").select("p_partkey", N.parse_bbox(text).alias("b"))
    return rows.select("p_partkey", "b.y0", "b.y1")


_NAMES = ("phase2d_tubular", "phase2d_vesicular", "GFP", "cp1_actin", "cp2_nuclei", "4i_r1_gh2ax", "cell_seg", "nucleoli_focus3d", "farred", "cell", "mCherry", "lysosome", "gfp_mito", "er_mcherry_seg", "cy5_nuclei", "cp_cell_gfp")
_NAMES_SQL = "n(k, name) AS (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(_NAMES)) + ")"


def _named(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query(
    f"""WITH {_NAMES_SQL} SELECT p_partkey, CASE WHEN regexp_matches(lower(name), 'cell_mask|cell_seg|cp_cell|nuclear|nuclei|nucleoli|vesicular') THEN false
    ELSE regexp_matches(lower(name), 'tubular|gfp|mcherry|cy5|^cp1_|^cp2_|^4i_') END AS is_network,
    CASE WHEN regexp_matches(lower(name), '^(4i_|cp1_|cp2_)') THEN lower(name) WHEN regexp_matches(lower(name), '^(phase2d|focus3d)|^nucleoli_(phase2d|focus3d)$') THEN 'phase'
      WHEN lower(name) IN ('gfp', 'mcherry') THEN lower(name) WHEN lower(name) IN ('cy5', 'farred') THEN 'cy5' ELSE 'agnostic' END AS bucket
    FROM part JOIN n ON k = p_partkey % {len(_NAMES)}"""
)
def p10_network_and_bucket(spark, sf_dir):
    rows = _named(spark, sf_dir)
    return rows.select("p_partkey", N.is_network(F.col("name")).alias("is_network"), N.channel_bucket(F.col("name")).alias("bucket"))


@query(
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '_' || lower(p_brand) || ' (mouse-488)' WHEN 1 THEN ' ' || p_type || ' ' WHEN 2 THEN p_type || '_' || p_brand ELSE 'Live Cell Dye' END AS name FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(split_part(split_part(name, '(', 1), '_', 1)) WHEN 3 THEN 'dye' ELSE lower(trim(name)) END AS shown,
    trim(regexp_replace(regexp_replace(lower(trim(name)), '[ /,()]', '_', 'g'), '_+', '_', 'g'), '_') AS safe,
    replace(CASE WHEN contains(name, '_') THEN substr(name, instr(name, '_') + 1) ELSE name END, ' ', '_') AS token FROM n"""
)
def p16_channel_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat("p_brand", F.lit("_"), F.lower("p_brand"), F.lit(" (mouse-488)")))
        .when(k == 1, F.concat(F.lit(" "), "p_type", F.lit(" ")))
        .when(k == 2, F.concat("p_type", F.lit("_"), "p_brand"))
        .otherwise("Live Cell Dye")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    c = F.col("name")
    return rows.select("p_partkey", N.shown_channel(c, (("live cell dye", "dye"),)).alias("shown"), N.safe_name(c).alias("safe"), N.file_token(c).alias("token"))


@query(
    f"""WITH {_NAMES_SQL} SELECT p_partkey, CASE WHEN lower(name) IN ('gfp', 'mcherry') THEN lower(name) WHEN lower(name) = 'farred' THEN 'cy5'
    WHEN regexp_matches(lower(name), '^(cp1_|cp2_|4i_)') THEN lower(name) END AS physical, coalesce(ends_with(lower(name), '_nuclei'), false) AS excluded
    FROM part JOIN n ON k = p_partkey % {len(_NAMES)}"""
)
def p17_physical_channel(spark, sf_dir):
    rows = _named(spark, sf_dir)
    return rows.select("p_partkey", N.physical_channel(F.col("name")).alias("physical"), N.is_excluded_pair(F.lit("marker"), F.col("name")).alias("excluded"))


@query(
    """SELECT c_custkey, 'A/' || (c_custkey % 3) || '/0' AS well, 'A/' || (c_custkey % 3) || '/0' AS bare FROM customer"""
)
def p19_wells(spark, sf_dir):
    k = (F.col("c_custkey") % 3).cast("string")
    form = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("A"), k)).otherwise(F.concat(F.lit("A/"), k))
    rows = table(spark, sf_dir, "customer").select("c_custkey", N.canonical_well(form).alias("well"))
    return rows.select("c_custkey", "well", N.bare_well(F.concat("well", F.lit("_exp12_20260219"))).alias("bare"))


@query(
    """WITH p AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS lo, (p_size / 4.0::DOUBLE) * 8 AS hi FROM part)
    SELECT p_partkey, i::INTEGER AS i, round(lo / 0.325::DOUBLE * pow(hi / lo, i / 4.0::DOUBLE), 6) AS sigma FROM p, range(0, 5) t(i)"""
)
def p24_sigma_grid(spark, sf_dir):
    low = F.col("p_size") / 4.0
    grid = N.sigma_grid(low, low * 8, 0.325, 5)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.posexplode(grid).alias("i", "sigma")))


@query(
    """WITH s AS (SELECT o_orderkey, 50 * (o_orderstatus = 'F')::INTEGER + 20 * o_totalprice / max(o_totalprice) OVER () + 5 * (o_orderkey % 4) AS score FROM orders),
    c AS (SELECT quantile_cont(score, 0.4) AS cut FROM s) SELECT o_orderkey, round(score, 6) AS score, score <= cut AS light FROM s, c"""
)
def p25_complexity_split(spark, sf_dir):
    """Complexity score of cells and its split at the 40th percentile."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    scored = A.complexity(o, F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_orderkey") % 4).select("o_orderkey", "score")
    return rounded(A.split_at_quantile(scored, "score"))


@query(
    """SELECT c_custkey, floor(coalesce(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END, 999999) / 512)::BIGINT AS cy, floor((c_custkey % 5000) / 512.0)::BIGINT AS cx FROM customer"""
)
def p32_chunk_key(spark, sf_dir):
    y = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", N.chunk_key(y, F.col("c_custkey") % 5000).alias("k"))
    return rows.select("c_custkey", "k.cy", "k.cx")


@query(
    """SELECT count(*) AS n, sum((props->>'$.k')::BIGINT) AS total FROM (SELECT '{"k": ' || (event_id % 10) || '}' AS props FROM events)"""
)
def s13_json_config(spark, sf_dir):
    """Configuration text is read with a stated schema, so nothing is inferred by a scan."""
    text = F.concat(F.lit('{"k": '), (F.col("event_id") % 10).cast("string"), F.lit("}"))
    parsed = table(spark, sf_dir, "events").select(F.from_json(text, "k long").alias("p"))
    return parsed.agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query(
    """SELECT c_custkey, replace(lower(c_mktsegment), ' ', '_') || '_frangi_seg' AS full_name, left(replace(lower(c_mktsegment), ' ', '_'), 5) || '_seg' AS legacy,
    c_mktsegment AS marker FROM customer"""
)
def p21_label_names(spark, sf_dir):
    seg = F.col("c_mktsegment")
    label = F.concat(F.lit("early, late endosome, "), seg, F.lit(" (mouse 488) SPY555"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", N.label_name(seg, F.lit("frangi")).alias("full_name"), N.label_name(seg, length=5).alias("legacy"), N.marker_of(label).alias("marker")
    )


#: Labels by the remainder of the customer's key; # stands for the market segment.
_LABELS = (
    "Phase", " phase ", "no label", "Empty", "empty, no label", "#", "#, no label", "early, late endosome, #", "mitochondria, # live cell dye", "ER, #-2 Live-Cell Dye", "actin, # excitation",
    "golgi, bleedthough", "autofluorescence, No Label", "nucleus, #  red\tdye (mouse 488)", "tubulin, _#_", "lipid, (#)", ",", "membrane,", "#  Live Cell excitation", None,
)


def _label_sql() -> str:
    whens = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "replace('" + v.replace("\t", "' || chr(9) || '") + "', '#', c_mktsegment)") for k, v in enumerate(_LABELS))
    return f"SELECT c_custkey, CASE c_custkey % {len(_LABELS)} {whens} END AS label FROM customer"


@query(
    rf"""WITH l AS ({_label_sql()}), t AS (SELECT c_custkey, trim(label, ' ' || chr(9)) AS label FROM l),
    p AS (SELECT *, trim(list_extract(string_split(label, ','), -1), ' ' || chr(9)) AS tail, trim(array_to_string(list_slice(string_split(label, ','), 1, len(string_split(label, ',')) - 1), ','), ' ' || chr(9)) AS head FROM t),
    n AS (SELECT *, CASE WHEN lower(tail) IN ('no label', '') THEN head ELSE tail END AS name FROM p), b AS (SELECT *, CASE WHEN lower(name) = 'bleedthough' THEN 'bleedthrough' ELSE name END AS v FROM n),
    s1 AS (SELECT *, trim(regexp_replace(v, '(?i) live cell dye$', '')) AS v1 FROM b), s2 AS (SELECT *, trim(regexp_replace(v1, '(?i) live-cell dye$', '')) AS v2 FROM s1), s3 AS (SELECT *, trim(regexp_replace(v2, '(?i) live cell$', '')) AS v3 FROM s2),
    s4 AS (SELECT *, trim(regexp_replace(v3, '(?i) excitation$', '')) AS v4 FROM s3)
    SELECT c_custkey, CASE WHEN lower(label) NOT IN ('', 'phase', 'no label', 'empty', 'empty, no label') THEN nullif(trim(regexp_extract(regexp_replace(v4, '\s+', '_', 'g'), '^[A-Za-z0-9_\-]+'), '_-'), '') END AS marker FROM s4"""
)
def p22_markers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    label = F.lit(None).cast("string")
    for k, text in enumerate(_LABELS):
        label = F.when(F.col("c_custkey") % len(_LABELS) == k, F.replace(F.lit(text), F.lit("#"), F.col("c_mktsegment"))).otherwise(label)
    return c.select("c_custkey", N.marker_of(label).alias("marker"))


@query(
    """WITH f AS (SELECT lower(CASE p_brand WHEN 'Brand#11' THEN 'B11' ELSE p_brand END) AS token, CASE p_size % 3 WHEN 0 THEN 'cell-b' WHEN 1 THEN 'cell-a' ELSE 'other' END AS folder, p_name || p_partkey AS path FROM part),
    r AS (SELECT token, path, row_number() OVER (PARTITION BY token ORDER BY folder <> 'cell-a', path) AS rn FROM f WHERE folder <> 'other')
    SELECT token AS p_brand, path FROM r WHERE rn = 1"""
)
def p20_best_source(spark, sf_dir):
    folder = F.element_at(F.array(F.lit("cell-b"), F.lit("cell-a"), F.lit("other")), (F.col("p_size") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select("p_brand", folder.alias("folder"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    return N.best_source(files, "p_brand", "folder", ("cell-a", "cell-b"), {"Brand#11": "B11"})


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ctl' ELSE c_name END AS "sgRNA",
    CASE WHEN c_nationkey = 3 THEN 'neg_ctrl' ELSE c_mktsegment END AS gene_name FROM (SELECT * FROM customer)"""
)
def p03_bridge_custom(spark, sf_dir):
    k = F.col("c_custkey") % 5
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k > 1, F.col("c_name")).alias("sgRNA"), F.when(k == 1, "ctl").alias("barcode"), F.col("c_mktsegment").alias("target"),
        F.when(F.col("c_nationkey") == 3, "neg_ctrl").otherwise("sample").alias("row_type"),
    )
    return N.bridge_custom(rows, "target").select("c_custkey", "sgRNA", "gene_name")


QUERIES, ORACLES = query.queries, query.oracles
