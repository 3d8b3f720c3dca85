"""queries() and oracle_sql() of the reference's operators. Docstrings and comments carry the operator ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import codes as C
from gridloom.functions import colour as K
from gridloom.functions import geometry as G
from gridloom.operators import cells as O
from gridloom.operators import corrections as R
from gridloom.operators import datasets as D
from gridloom.operators import decode as X
from gridloom.operators import dictionary as L
from gridloom.operators import evaluation as E
from gridloom.operators import jobs as J
from gridloom.operators import palette as P
from gridloom.plans.surrogate import Source, duck
from gridloom.streaming import lifecycle as S

_QUERIES: dict[str, Callable[[Source], DataFrame]] = {}
_SQL: dict[str, str] = {}
R6 = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = duck(" ".join(sql.split()))
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Source(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


NAT = "substr(code,1,1), coalesce(try_cast(nullif(regexp_extract(code, '^.([0-9]+)', 1), '') AS bigint), 9223372036854775807), code"
STATUS = "CASE WHEN c.code = 'BLANK' THEN 'BLANK' WHEN d.code IS NOT NULL THEN 'MAPPED' ELSE 'UNMAPPED' END"
ST = f"st AS (SELECT c.*, {STATUS} AS status, d.code AS color_code, d.name AS color_name, d.hex AS color_hex FROM cells c LEFT JOIN dict d ON upper(c.code) = upper(d.code) AND c.code <> 'BLANK')"


def _status(s: Source) -> DataFrame:
    return O.with_status(s("cells"), s("dict"))


@query(f"WITH {ST}, g AS (SELECT coalesce(corrected_code, code) AS code, count(*) AS count FROM st GROUP BY 1) SELECT code, count, cast(row_number() OVER (ORDER BY {NAT}) AS int) AS place FROM g")
def bead_list(s):
    """JON-01, AGG-05, SRT-02, PRJ-06, SNK-03."""
    cells = _status(s).withColumn("code", C.effective_code(F.col("code"), F.col("corrected_code")))
    return O.with_rank(O.bead_list(cells), C.natural_key(F.col("code")), "place")


@query(f"WITH {ST} SELECT status, count(*) AS n, count(color_code) AS coloured, round(avg(confidence), 6) AS conf FROM st GROUP BY 1")
def status_mapping(s):
    return _status(s).groupBy("status").agg(F.count("*").alias("n"), F.count("color_code").alias("coloured"), R6(F.avg("confidence")).alias("conf"))


@query("SELECT job, row, col, code, confidence FROM cells")
def cell_upsert_lww(s):
    """SNK-03, STM-05."""
    order = [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return O.latest(s("raw_cells"), O.KEY, *order).select(*O.KEY, "code", "confidence")


@query("""SELECT g.id AS job, count(*) AS cells, count_if(c.code IS NULL) AS filled, sum(CASE WHEN c.code IS NULL THEN (r.row + 1) * 10 + k.col ELSE 0 END)::bigint AS check_sum
    FROM jobs g CROSS JOIN (SELECT unnest(range(7)) AS row) r CROSS JOIN (SELECT unnest(range(8)) AS col) k LEFT JOIN cells c ON c.job = g.id AND c.row = r.row AND c.col = k.col GROUP BY 1""")
def gap_fill_grid(s):
    """ARR-04, JON-06, SET-07."""
    full = O.fill_gaps(s.jobs_as_grids(), s("cells", by="job").select(*O.KEY, "code"), strays=False)
    gap = F.coalesce("code", F.lit("UNMAPPED")) == "UNMAPPED"
    return full.groupBy("job").agg(F.count("*").alias("cells"), F.count_if(gap).alias("filled"), F.sum(F.when(gap, (F.col("row") + 1) * 10 + F.col("col")).otherwise(0)).cast("long").alias("check_sum"))


@query("SELECT id, round(least(100.0, processed_cells * 100.0 / total_cells), 6)::double AS percent FROM jobs")
def progress_percent(s):
    return s("jobs").select("id", R6(C.progress_percent(F.col("processed_cells"), F.col("total_cells"))).alias("percent"))


@query("SELECT id, status, created_at FROM jobs WHERE status = 'SUCCEEDED' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def list_jobs_page(s):
    """SRT-01, SRT-06, PRD-01, PRD-02."""
    return J.list_jobs(s("jobs"), "SUCCEEDED", 3, 20, "created_at").select("id", "status", "created_at")


@query("SELECT status, count(*) AS total, cast(ceil(count(*) / 20.0) AS bigint) AS total_pages FROM jobs GROUP BY 1")
def jobs_status_count(s):
    """AGG-01."""
    return s("jobs").groupBy("status").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("total_pages"))


@query("SELECT id, rows, cols FROM jobs WHERE status = 'SUCCEEDED' ORDER BY created_at ASC, id LIMIT 20")
def list_blueprints_page(s):
    return J.list_jobs(s("jobs"), "SUCCEEDED", 1, 20, "created_at", "asc").select("id", "rows", "cols")


@query(f"SELECT code, name, hex FROM dict WHERE upper(code) LIKE 'E%' ORDER BY {NAT} LIMIT 30 OFFSET 0")
def colors_prefix_natural_page(s):
    """PRD-03, SRT-02, SRT-07."""
    return O.page(s("dict").filter(C.search_prefix(F.col("code"), "e")), 1, 30, C.natural_key(F.col("code"))).select("code", "name", "hex")


@query("SELECT code, name, hex FROM dict WHERE upper(code) = 'E1'")
def color_point_lookup_ci(s):
    """JON-01, SRC-03."""
    return s("dict").filter(F.upper("code") == "E1").select("code", "name", "hex")


@query("SELECT id, status, rows AS grid_rows, CASE WHEN status = 'FAILED' AND error_code IS NOT NULL THEN error_code END AS error, CASE WHEN status = 'FAILED' AND error_code IS NOT NULL THEN substr(error_message, 1, 500) END AS message FROM jobs")
def job_detail_struct(s):
    """PRJ-03, STR-14."""
    jobs = s("jobs").withColumns({"color_library_version": F.lit("v1"), "model_snapshot": F.lit("m1")})
    return J.detail(jobs).select("id", "status", F.col("grid.rows").alias("grid_rows"), F.col("error.code").alias("error"), F.col("error.message").alias("message"))


@query("""SELECT id, '{"id":' || id || ',"status":"' || status || '","processedCells":' || processed_cells || ',"totalCells":' || total_cells || '}' AS body FROM jobs""")
def job_summary_json(s):
    """PRJ-04, SNK-17, ARR-01."""
    return J.summary(s("jobs"))


@query(f"WITH {ST} SELECT job, row, col, code, color_code, CASE WHEN color_code IS NOT NULL THEN coalesce(color_name, '') END AS color_name, color_hex FROM st")
def cell_dto(s):
    """PRJ-05."""
    return O.to_dto(_status(s)).select(*O.KEY, "code", F.col("color.code").alias("color_code"), F.col("color.name").alias("color_name"), F.col("color.hex").alias("color_hex"))


@query(f"WITH {ST} SELECT job, row, col, code, status, confidence FROM st WHERE status = 'UNMAPPED' OR confidence < 0.3")
def review_cells(s):
    """PRD-09."""
    return O.review(_status(s), 0.3).select(*O.KEY, "code", "status", "confidence")


@query(f"WITH {ST} SELECT job, row, col, code FROM st WHERE instr((row + 1) || ':' || (col + 1), '5') > 0 OR instr(upper(code), '5') > 0 OR coalesce(instr(upper(corrected_code), '5') > 0, false)")
def visible_cells_search(s):
    """PRD-10."""
    return O.visible(_status(s), "all", "5").select(*O.KEY, "code")


@query(f"WITH {ST} SELECT job, row, col, corrected_code FROM st WHERE corrected_code IS NOT NULL AND (status = 'UNMAPPED' OR confidence < 0.9)")
def fixed_filter(s):
    return O.visible(_status(s), "review", "", "fixed").select(*O.KEY, "corrected_code")


@query(f"WITH {ST} SELECT job, count_if(status = 'UNMAPPED') AS unmapped, count_if(corrected_code IS NOT NULL) AS corrected, count_if(status = 'UNMAPPED' OR confidence < 0.9) AS review, count_if(coalesce(corrected_code, code) = 'E1') AS locked FROM st GROUP BY 1")
def conditional_counts(s):
    """AGG-08, AGG-09, AGG-10."""
    return O.figures(_status(s))


@query(f"WITH {ST} SELECT job, row, col FROM st WHERE status = 'UNMAPPED' AND code <> 'BLANK'")
def unmapped_cells(s):
    """PRD-11."""
    return O.unmapped(_status(s)).select(*O.KEY)


@query("SELECT code, name FROM dict WHERE contains(code, 'E1') OR contains(lower(name), 'e1')")
def correction_candidates(s):
    """PRD-12."""
    return O.candidates(s("dict"), "e1").select("code", "name")


@query("SELECT job, arg_min(code, (-length(code), row, col)) AS code FROM cells WHERE code NOT IN ('BLANK', 'UNMAPPED', '') GROUP BY 1")
def longest_code(s):
    """AGG-11."""
    return O.longest_code(s("cells"))


@query("SELECT code, count(*) AS count, min(job * 100 + row * 10 + col) AS first FROM cells WHERE job % 10 = 0 AND row < 3 GROUP BY 1")
def selection_breakdown(s):
    """AGG-06."""
    out = O.breakdown(s("cells"), s("cells").filter("job % 10 = 0 AND row < 3").select(*O.KEY))
    return out.select("code", "count", (F.col("first_job") * 100 + F.col("first_row") * 10 + F.col("first_col")).alias("first"))


@query("""SELECT c.job, c.row, c.col FROM cells c WHERE c.job IN (SELECT job FROM cells WHERE row = 0 AND col = 3) AND c.job IN (SELECT job FROM cells WHERE row = 2 AND col = 1)
    AND c.row * 8 + c.col BETWEEN 3 AND 17""")
def range_between_anchor(s):
    """WIN-02: anchor after target."""
    return O.range_between(s("cells"), (2, 1), (0, 3)).select(*O.KEY)


@query("SELECT id, CASE WHEN id % 4 = 0 AND id % 6 = 0 THEN 'D' WHEN id % 2 = 0 THEN 'A,B,C,D' ELSE 'A,B,C' END AS picked FROM jobs")
def toggle_keys(s):
    """SET-05: keys A,B,C against a selection that holds all, some or none of them."""
    sel = F.when((F.col("id") % 4 == 0) & (F.col("id") % 6 == 0), F.array(*map(F.lit, "ABCD"))).when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("D"))).otherwise(F.array(F.lit("B")))
    return s("jobs").select("id", F.array_join(O.toggle(sel, F.array(*map(F.lit, "ABC"))), ",").alias("picked"))


@query("SELECT job, row, col FROM cells WHERE row BETWEEN 1 AND 3 AND col BETWEEN 2 AND 5")
def viewport_culling(s):
    """RNG-01."""
    return s("cells").filter(G.visible(F.col("row"), F.col("col"), 1, 4, 2, 6)).select(*O.KEY)


@query(f"WITH {ST}, k AS (SELECT coalesce(code, color_hex, 'default') AS key, color_hex FROM st) SELECT key, count(*) AS count, min(color_hex) AS color FROM k WHERE key <> 'default' GROUP BY 1")
def colour_legend(s):
    """AGG-07, STR-16."""
    return O.legend(_status(s))


@query("SELECT 'jobs' AS tab, count(*) AS n FROM jobs WHERE id % 7 <> 0 UNION ALL SELECT 'cells', count(*) FROM cells WHERE job % 7 <> 0 OR job NOT IN (SELECT id FROM jobs)")
def delete_cascade(s):
    """SNK-05."""
    left = J.delete({"jobs": (s("jobs"), "id"), "cells": (s("cells"), "job")}, s("jobs").filter("id % 7 = 0").select("id"))
    one = lambda k: left[k].agg(F.lit(k).alias("tab"), F.count("*").alias("n"))
    return one("jobs").unionByName(one("cells"))


@query("SELECT count(*) AS staged, count(DISTINCT job) AS jobs FROM cells WHERE job NOT IN (SELECT id FROM jobs WHERE status = 'SUCCEEDED')")
def prune_history(s):
    """SNK-07."""
    return J.prune(s("cells"), s("jobs")).agg(F.count("*").alias("staged"), F.countDistinct("job").alias("jobs"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN nullif(trim('  new  '), '') ELSE name END AS name FROM jobs")
def rename_jobs(s):
    """SNK-06, STR-13."""
    return J.rename(s("jobs"), F.when(F.col("id") % 5 == 0, F.col("id")), F.lit("  new  ")).select("id", "name")


@query("""SELECT g.id AS job, count(*) AS cells, max(c.row) AS last_row FROM cells c JOIN jobs g ON g.id = c.job WHERE c.job IN (SELECT job FROM cells GROUP BY job HAVING count(*) >= 4) GROUP BY 1""")
def complete_jobs(s):
    """SNK-04, AGG-02, JON-02."""
    blueprints, cells = J.complete(s("jobs").withColumn("total_cells", F.lit(4)), s("cells"))
    return J.blueprint_detail(blueprints, cells).select("job", F.size("cells").cast("long").alias("cells"), F.array_max(F.transform("cells", lambda c: c["row"])).alias("last_row"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 600 BETWEEN 1 AND 500 THEN NULL ELSE 'INVALID_PARAMETER' END AS error, nullif(trim(o_orderpriority), '') AS name, (o_orderkey % 600) * 8 AS total_cells FROM orders")
def create_jobs(s):
    """SNK-02, PRD-04."""
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x", 0), ("y", 0), ("width", 9), ("height", 9))))
    req = s.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 600).alias("rows"), F.lit(8).alias("cols"), box.alias("crop_box"), F.array(F.lit("B"), F.lit("A")).alias("codes"), F.col("o_orderpriority").alias("name"), F.lit("i.png").alias("image"), F.col("o_orderdate").alias("at"))
    return J.create(req, F.lit("v1"), F.lit("m1")).select("id", "error", "name", "total_cells")


@query("SELECT d.code FROM dict d WHERE upper(d.code) IN (SELECT upper(code) FROM cells)")
def vocab_intersection(s):
    """JON-07, SET-03."""
    return L.vocabulary(s("dict").select("code"), s("cells").select("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'A1,' || upper(p_brand) END AS codes FROM part")
def valid_code_parse(s):
    """PRJ-08, ARR-02, ARR-03."""
    raw = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" , a1")))
    return s.table("part").select("p_partkey", F.array_join(C.parse_codes(raw), ",").alias("codes"))


@query("SELECT code, CASE WHEN regexp_full_match(code, '[A-Za-z][0-9]{1,3}') THEN '12x' ELSE '12x,' || code END AS bad FROM (SELECT DISTINCT code FROM cells) x")
def code_format_violations(s):
    """PRD-05, PRD-06, PRD-13, PRD-14."""
    return s("cells").select("code").distinct().select("code", F.array_join(C.bad_codes(F.array(F.lit("12x"), F.col("code"))), ",").alias("bad"))


@query("""SELECT job, row, col, code AS a, code AS b, CASE WHEN regexp_full_match(code, '[A-Z]+[0-9]+') OR code = 'BLANK' THEN code END AS c FROM cells""")
def label_from_filename(s):
    """STR-02, STR-03, STR-04, STR-08, SRC-12: labels read back from three kinds of names."""
    code, row, col = F.col("code"), F.col("row").cast("int"), F.col("col").cast("int")
    return s("cells").select(
        *O.KEY, C.label_of(C.board_cell_name(code, row, col)).alias("a"), C.label_of(C.export_name(code, row, col, F.lit(0), F.lit(9)), True).alias("b"), C.code_from_filename(F.format_string("sample_%03d_%s.png", row, code)).alias("c")
    )


@query("SELECT job, cast(row AS int) AS row, cast(col AS int) AS col, upper(code) AS token FROM cells")
def region_triples_extract(s):
    """STR-06, JON-16."""
    text = F.concat(F.lit("x R"), F.col("row"), F.lit("C"), F.col("col"), F.lit("="), F.col("code"), F.lit("; y"))
    return s("cells").select("job", F.explode(C.region_triples(text)).alias("t")).select("job", "t.*")


@query("SELECT p_partkey, upper(substr(p_type, 1, 1)) || p_size AS code FROM part")
def answer_code_cleanup(s):
    """STR-05."""
    code = F.concat(F.lower(F.substring("p_type", 1, 1)), F.col("p_size"))
    return s.table("part").select("p_partkey", C.answer_code(F.concat(F.lit("code: "), code, F.lit(". sure"))).alias("code"))


@query("SELECT url, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM pages")
def sanitize_filename(s):
    """STR-01."""
    return s.table("pages").select("url", C.sanitize_filename(F.col("url")).alias("safe"))


@query("SELECT code, count(DISTINCT hex) AS colours, count(*) AS entries FROM dict_raw GROUP BY 1 HAVING count(DISTINCT hex) > 1")
def dict_conflicts(s):
    """AGG-24."""
    return L.conflicts(s("dict_raw"))


@query("""WITH e AS (SELECT *, max((brand = 'Brand#11')::int) OVER g AS pref, min(ord) OVER g AS first FROM dict_raw WINDOW g AS (PARTITION BY code, hex)),
    f AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY pref DESC, first) AS place, row_number() OVER (PARTITION BY code, hex ORDER BY brand_rank, ord) AS inside FROM e)
    SELECT code, name, hex, brand FROM f WHERE place = 1 AND inside = 1
    UNION ALL SELECT upper(brand) || '-' || code, name, hex, brand FROM (SELECT *, row_number() OVER (PARTITION BY brand, code ORDER BY first, ord) AS n FROM f WHERE place > 1) x WHERE n = 1""")
def dict_build_final(s):
    """PAL-01, WIN-06, SET-08, AGG-25."""
    return L.build_final(s("dict_raw"), "Brand#11")


@query("""WITH n AS (SELECT hex, brand, code FROM (SELECT *, row_number() OVER (PARTITION BY brand, code ORDER BY hex) AS n FROM dict_raw WHERE ord % 2 = 1) x WHERE n = 1),
    l AS (SELECT code, name, hex, brand FROM (SELECT *, row_number() OVER (PARTITION BY brand, code ORDER BY ord) AS n FROM dict_raw WHERE ord % 2 = 0) x WHERE n = 1),
    f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.brand = n.brand AND l.code = n.code)),
    nm AS (SELECT hex, min(name) AS name FROM l GROUP BY 1)
    SELECT f.brand, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.code = f.code AND l.brand <> f.brand AND l.hex <> f.hex) THEN upper(f.brand) || '-' || f.code ELSE f.code END AS final_code,
    coalesce(nm.name, f.code) AS name, f.hex, cast(row_number() OVER (PARTITION BY f.brand ORDER BY f.hex, f.code) AS int) AS sort_order FROM f LEFT JOIN nm ON nm.hex = f.hex""")
def dict_import(s):
    """PAL-02, WIN-03, WIN-04, JON-12, JON-13, SRC-10."""
    raw = s("dict_raw")
    library = O.latest(raw.filter("ord % 2 = 0"), ["brand", "code"], F.col("ord")).select("code", "name", "hex", "brand")
    return L.import_entries(raw.filter("ord % 2 = 1").select("hex", "brand", "code"), library)


@query("""WITH p AS (SELECT 'duplicate' AS kind, code FROM dict_raw GROUP BY code HAVING count(*) > 1 UNION ALL SELECT 'no_brand', code FROM dict_raw WHERE brand = ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY code) AS n FROM p) SELECT kind, count(*) AS n, string_agg(CASE WHEN n <= 10 THEN code END, ',' ORDER BY n) AS first_codes FROM r GROUP BY 1""")
def dict_validate(s):
    """AGG-23, PAL-03."""
    return L.problems(s("dict_raw"))


@query("SELECT 'sha256:' || sha256(string_agg(code, '|' ORDER BY code)) AS version, count(*) AS codes FROM (SELECT DISTINCT code FROM dict_raw) x")
def dict_version_hash(s):
    """STR-10, STR-11, STR-12, STR-15."""
    return L.version(s("dict_raw"))


@query("SELECT brand, count(*) AS n, count(DISTINCT code) AS codes FROM dict_raw GROUP BY 1")
def brand_counts(s):
    """AGG-18, AGG-22, PAL-21."""
    return L.brand_counts(s("dict_raw"))


@query("SELECT brand, code, hex, cast(row_number() OVER (ORDER BY brand, code, hex) AS int) AS sort_order FROM dict")
def sort_order_global(s):
    """WIN-05."""
    return L.with_sort_order(s("dict")).select("brand", "code", "hex", "sort_order")


@query(f"SELECT code, cast(row_number() OVER (ORDER BY {NAT}) AS int) AS natural, cast(row_number() OVER (ORDER BY code = 'BLANK', lower(regexp_extract(code, '^([^0-9]*)', 1)), coalesce(try_cast(nullif(regexp_extract(code, '([0-9]+)', 1), '') AS bigint), -1), code) AS int) AS display FROM (SELECT DISTINCT code FROM cells) x")
def natural_rank(s):
    """SRT-02, SRT-03."""
    d = s("cells").select("code").distinct()
    return O.with_rank(O.with_rank(d, C.natural_key(F.col("code")), "natural"), C.display_key(F.col("code")), "display")


RGB = "('0x' || substr(hex, 2, 2))::int AS r, ('0x' || substr(hex, 4, 2))::int AS g, ('0x' || substr(hex, 6, 2))::int AS b"
HUE = "CASE WHEN greatest(r,g,b) = least(r,g,b) THEN NULL WHEN greatest(r,g,b) = r THEN 60.0::double * (g - b) / (greatest(r,g,b) - least(r,g,b)) WHEN greatest(r,g,b) = g THEN 60.0::double * (b - r) / (greatest(r,g,b) - least(r,g,b)) + 120 ELSE 60.0::double * (r - g) / (greatest(r,g,b) - least(r,g,b)) + 240 END"


@query(f"WITH c AS (SELECT code, {RGB} FROM dict), h AS (SELECT code, {HUE} AS h FROM c) SELECT code, round(coalesce(h, -1.0), 6) AS sort_hue, cast(CASE WHEN h IS NULL THEN 0 ELSE round(CASE WHEN h < 0 THEN h + 360 ELSE h END) END AS int) AS hue FROM h")
def hue_sort(s):
    """COL-03, COL-04, SRT-04."""
    c = K.rgb(F.col("hex"))
    return s("dict").select("code", R6(K.sort_hue(c)).alias("sort_hue"), K.hue(c).alias("hue"))


@query(f"WITH c AS (SELECT code, {RGB} FROM dict), l AS (SELECT *, (0.2126::double * r + 0.7152::double * g + 0.0722::double * b) / 255 AS y, 0.299::double * r + 0.587::double * g + 0.114::double * b AS z FROM c) SELECT code, round(y, 6) AS luma, CASE WHEN y > 0.5 THEN '#000000' ELSE '#FFFFFF' END AS txt, CASE WHEN z / 255 > 0.62 THEN 'dark' ELSE 'light' END AS viewer, z < 130 AS white, y > 0.8 AND greatest(r,g,b) - least(r,g,b) < 25 AS neutral, cast(floor((r + g + b) / 3) AS int) AS brightness FROM l")
def color_luma_contrast(s):
    """COL-05 to COL-08, PRD-17."""
    c = K.rgb(F.col("hex"))
    return s("dict").select("code", R6(K.luma709(c)).alias("luma"), K.text_colour(c).alias("txt"), K.viewer_text_colour(c).alias("viewer"), K.synth_text_is_white(c).alias("white"), K.near_neutral_light(c).alias("neutral"), K.brightness(c).alias("brightness"))


@query(f"SELECT code, {RGB}, CASE WHEN ascii(code) % 2 = 0 THEN hex END AS norm FROM dict")
def hex_to_rgb(s):
    """COL-01, PRD-19."""
    raw = F.when(F.ascii("code") % 2 == 0, F.lower(F.substring("hex", 2, 6))).otherwise(F.lit("#12345"))
    return s("dict").select("code", K.rgb(F.col("hex")).alias("c"), C.normalize_hex(raw).alias("norm")).select("code", "c.*", "norm")


EMB = "least(255, greatest(0, cast(floor(abs(embedding[{0}]) * 255) AS int)))"


def _pixels(s: Source) -> DataFrame:
    """Vectors as 21 pixels of three channels each."""
    v = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.abs(F.get("embedding", k)) * 255).cast("int")))
    px = s.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    return px.select("id", "k", *(v(F.col("k") * 3 + i).alias(c) for i, c in enumerate("rgb")))


PX = "px AS (SELECT vec_id AS id, k, " + ", ".join(EMB.format(f"k * 3 + {i + 1}") + f" AS {c}" for i, c in enumerate("rgb")) + " FROM embeddings CROSS JOIN (SELECT unnest(range(21)) AS k) x)"


@query(f"WITH {PX}, p AS (SELECT code, {RGB} FROM dict), q AS (SELECT px.id, px.k, p.code, (px.r - p.r) * (px.r - p.r) + (px.g - p.g) * (px.g - p.g) + (px.b - p.b) * (px.b - p.b) AS d2 FROM px CROSS JOIN p) SELECT id, k::int AS k, arg_min(code, (d2, code)) AS code, cast(min(d2) AS int) AS d2 FROM q GROUP BY 1, 2")
def nearest_palette(s):
    """JON-14, COL-02."""
    pixels = _pixels(s).select(F.struct("id", "k").alias("id"), "r", "g", "b")
    return P.nearest(pixels, s("dict")).select("id.id", "id.k", "code", "d2")


@query(f"WITH {PX}, h AS (SELECT id, r // 16 AS br, g // 16 AS bg, b // 16 AS bb, count(*) AS n, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY ALL) SELECT id, cast(round_even(arg_min(mr, (-n, br, bg, bb)), 0) AS int) AS r, cast(round_even(arg_min(mg, (-n, br, bg, bb)), 0) AS int) AS g, cast(round_even(arg_min(mb, (-n, br, bg, bb)), 0) AS int) AS b, max(n) AS n FROM h GROUP BY 1")
def dominant_color(s):
    """AGG-27, PAL-05."""
    return P.dominant(_pixels(s))


@query(f"WITH {PX}, h AS (SELECT id, r // 8 AS br, g // 8 AS bg, b // 8 AS bb, count(*) AS n, floor(avg(r)) AS mr, floor(avg(g)) AS mg, floor(avg(b)) AS mb FROM px GROUP BY ALL) SELECT id, cast(arg_min(mr, (-n, br, bg, bb)) AS int) AS r, cast(arg_min(mg, (-n, br, bg, bb)) AS int) AS g, cast(arg_min(mb, (-n, br, bg, bb)) AS int) AS b, max(n) AS n FROM h GROUP BY 1")
def dominant_color_export(s):
    """AGG-26."""
    return P.dominant(_pixels(s), 3, False)


@query(f"""WITH RECURSIVE p AS (SELECT code, {RGB} FROM dict), h AS (SELECT job, code, count(*) AS n, min((row, col)) AS f FROM cells GROUP BY 1, 2),
    o AS (SELECT h.job, h.code, p.r::int AS r, p.g::int AS g, p.b::int AS b, row_number() OVER (PARTITION BY h.job ORDER BY h.n DESC, h.f) AS i FROM h JOIN p ON p.code = h.code),
    w(job, i, standing, code, merged) AS (SELECT DISTINCT job, 0::bigint, []::struct(code varchar, r int, g int, b int)[], NULL::varchar, NULL::varchar FROM o UNION ALL
    SELECT o.job, o.i, CASE WHEN hit IS NULL THEN list_append(w.standing, struct_pack(code := o.code, r := o.r, g := o.g, b := o.b)) ELSE w.standing END, o.code, coalesce(hit, o.code)
    FROM w JOIN o ON o.job = w.job AND o.i = w.i + 1, LATERAL (SELECT (list_filter(w.standing, lambda x: (x.r - o.r) * (x.r - o.r) + (x.g - o.g) * (x.g - o.g) + (x.b - o.b) * (x.b - o.b) < 3600)[1]).code AS hit) z)
    SELECT c.job, c.row, c.col, coalesce(w.merged, c.code) AS code FROM cells c LEFT JOIN w ON w.job = c.job AND w.code = c.code""")
def frequency_merge(s):
    """PAL-06, JON-17, SRT-08: sequential inside a board's histogram."""
    return P.merge_similar(s("cells").select(*O.KEY, "code"), s("dict"), 60.0)


@query("SELECT p_partkey, cast(greatest(1, round_even(29 * p_size / (p_partkey % 40 + 1.0)::double, 0)) AS int) AS rows FROM part")
def grid_size(s):
    """PAL-04, MTH-06."""
    return s.table("part").select("p_partkey", G.grid_rows(F.lit(29), F.col("p_size"), (F.col("p_partkey") % 40 + 1).cast("double")).alias("rows"))


BX = "(job % 90) AS x, (job % 70) AS y, (300 + job % 211)::double AS w, (200 + job % 173)::double AS h"


def _rects(s: Source) -> DataFrame:
    e = {"x": "job % 90", "y": "job % 70", "w": "cast(300 + job % 211 AS double)", "h": "cast(200 + job % 173 AS double)"}
    return s("cells").select(*O.KEY, *(F.expr(v).alias(k) for k, v in e.items()))


ARGS = ("x", "y", "w", "h")


@query(f"WITH q AS (SELECT job, row, col, {BX} FROM cells), e AS (SELECT job, row, col, round(x + w * col / 8)::bigint AS x0, round(x + w * (col + 1) / 8)::bigint AS x1, round(y + h * row / 7)::bigint AS y0, round(y + h * (row + 1) / 7)::bigint AS y1 FROM q) SELECT job, row, col, x0 + greatest(1, round((x1 - x0) * 0.1::double)::bigint) AS x0, y0 + greatest(1, round((y1 - y0) * 0.1::double)::bigint) AS y0, x1 - greatest(1, round((x1 - x0) * 0.1::double)::bigint) AS x1, y1 - greatest(1, round((y1 - y0) * 0.1::double)::bigint) AS y1 FROM e")
def crop_rect_inference(s):
    """OCR-03."""
    return _rects(s).select(*O.KEY, G.inference_rect(*map(F.col, ARGS), F.lit(7), F.lit(8), F.col("row"), F.col("col")).alias("r")).select(*O.KEY, "r.*")


@query(f"WITH q AS (SELECT job, row, col, {BX} FROM cells), e AS (SELECT job, row, col, floor(x + w * col / 8)::bigint AS x0, floor(x + w * (col + 1) / 8)::bigint AS x1, floor(y + h * row / 7)::bigint AS y0, floor(y + h * (row + 1) / 7)::bigint AS y1 FROM q), i AS (SELECT *, greatest(1, floor((x1 - x0) * 0.1::double)::bigint) AS dx, greatest(1, floor((y1 - y0) * 0.1::double)::bigint) AS dy FROM e) SELECT job, row, col, x0 + dx AS x, y0 + dy AS y, greatest(1, x1 - x0 - 2 * dx) AS w, greatest(1, y1 - y0 - 2 * dy) AS h FROM i")
def crop_rect_export(s):
    """OCR-04."""
    return _rects(s).select(*O.KEY, G.export_rect(*map(F.col, ARGS), F.lit(7), F.lit(8), F.col("row"), F.col("col")).alias("r")).select(*O.KEY, "r.*")


@query(f"WITH q AS (SELECT job, row, col, {BX} FROM cells) SELECT job, row, col, round(x + col * (w / 8) + round(w / 8 * 0.1::double), 6) AS x, round(y + row * (h / 7) + round(h / 7 * 0.1::double), 6) AS y, round(greatest(1.0::double, w / 8 - 2 * round(w / 8 * 0.1::double)), 6) AS w, round(greatest(1.0::double, h / 7 - 2 * round(h / 7 * 0.1::double)), 6) AS h FROM q")
def crop_rect_preview(s):
    """OCR-05."""
    r = G.preview_rect(*map(F.col, ARGS), F.lit(7), F.lit(8), F.col("row"), F.col("col"))
    return _rects(s).select(*O.KEY, r.alias("r")).select(*O.KEY, *(R6(F.col(f"r.{c}")).alias(c) for c in ARGS))


@query("SELECT job, row, col, CASE WHEN row < 5 AND col < 6 THEN row END AS hit_row, CASE WHEN row < 5 AND col < 6 THEN col END AS hit_col FROM cells")
def hit_test_cells(s):
    """OCR-22, PRD-07."""
    hit = G.hit_test(F.col("col") * 16 + 3.0, F.col("row") * 16 + 9.0, F.lit(0.0), F.lit(0.0), F.lit(16.0), F.lit(5), F.lit(6))
    return s("cells").select(*O.KEY, hit.alias("h")).select(*O.KEY, F.col("h.row").alias("hit_row"), F.col("h.col").alias("hit_col"))


@query("SELECT p_partkey, least(greatest(8, round(p_size * 1.5::double)), 60)::bigint AS w, greatest(0, least(60 - least(greatest(8, round(p_size * 1.5::double)), 60)::bigint, p_partkey % 100 - 20)) AS x FROM part")
def clamp_crop(s):
    """OCR-02, OCR-21, MTH-07, PAL-16."""
    box = G.clamp_crop(F.col("p_partkey") % 100 - 20, F.lit(0), F.col("p_size") * 1.5, F.lit(20), F.lit(60), F.lit(60))
    return s.table("part").select("p_partkey", box.alias("b")).select("p_partkey", "b.w", "b.x")


CHARS = ["<blank>", *"ABCDEFG"]
FR = "fr AS (SELECT vec_id, t, embedding[t * 8 + 1 : t * 8 + 8]::double[] AS f FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS t) x), lp AS (SELECT vec_id, t, f, list_max(f) AS top, list_max(f) + ln(list_sum(list_transform(f, lambda x: exp(x - list_max(f))))) AS lse, list_position(f, list_max(f)) - 1 AS k FROM fr), em AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS kb FROM lp)"
GR = "gr AS (SELECT vec_id, coalesce(string_agg(substr('ABCDEFG', k::int, 1), '' ORDER BY t) FILTER (k <> 0 AND k IS DISTINCT FROM kb), '') AS greedy_code, coalesce(exp(avg(top - lse) FILTER (k <> 0 AND k IS DISTINCT FROM kb)), 0) AS conf FROM em GROUP BY 1)"


def _log_probs(s: Source) -> DataFrame:
    fr = X.frames(F.col("embedding").cast("array<double>"), 8)
    return s.table("embeddings").select("vec_id", "embedding", F.transform(fr, X.log_softmax).alias("lp"))


@query(f"WITH {FR} SELECT vec_id, t::int AS t, round(top - lse, 6) AS best, k::int AS k FROM lp")
def log_softmax_frames(s):
    """MTH-01, MTH-02, ARR-07."""
    return _log_probs(s).select("vec_id", F.posexplode("lp").alias("t", "f")).select("vec_id", "t", R6(F.array_max("f")).alias("best"), X.arg_max(F.col("f")).alias("k"))


@query(f"WITH {FR}, {GR} SELECT vec_id, greedy_code, round(conf, 6) AS conf FROM gr")
def ctc_greedy(s):
    """WIN-01, MTH-03, OCR-12."""
    g = _log_probs(s).select("vec_id", X.greedy(F.col("lp")).alias("g"))
    return g.select("vec_id", X.spell(F.col("g.indices"), CHARS).alias("greedy_code"), R6(F.col("g.confidence")).alias("conf"))


TRIE = ["A", "AB", "ABC", "BA", "BD", "C", "CA", "CAB", "DE", "DEF", "E", "EG", "FA", "FAB", "G", "GE", "GED"]
VOC = ", ".join(f"('{c}')" for c in TRIE)
PRE = ", ".join(f"('{p}')" for p in sorted({c[:n] for c in TRIE for n in range(1, len(c) + 1)}))
TD = f"""pre(p) AS (VALUES {PRE}), lf AS (SELECT vec_id, t, list_transform(f, lambda x: x - lse) AS l FROM lp),
    w(vec_id, t, node, score, last, live) AS (SELECT vec_id, 0::bigint, ''::varchar, 0::double, ''::varchar, false FROM embeddings UNION ALL
    SELECT w.vec_id, w.t + 1, CASE WHEN emit AND NOT (w.live AND b.ch = w.last) THEN w.node || b.ch ELSE w.node END, w.score + CASE WHEN emit THEN b.s ELSE 0 END,
    CASE WHEN emit AND NOT (w.live AND b.ch = w.last) THEN b.ch ELSE w.last END, emit
    FROM w JOIN lf ON lf.vec_id = w.vec_id AND lf.t = w.t LEFT JOIN LATERAL (SELECT substr(p, length(p), 1) AS ch, lf.l[instr('ABCDEFG', substr(p, length(p), 1)) + 1] AS s FROM pre
    WHERE length(p) = length(w.node) + 1 AND starts_with(p, w.node) ORDER BY s DESC, ch LIMIT 1) b ON true, LATERAL (SELECT coalesce(b.s > lf.l[1], false) AS emit) z)"""


def _decoded(s: Source) -> DataFrame:
    trie = X.Trie(TRIE, CHARS)
    base = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return X.constrained(base, "x", 8, trie, chars=CHARS).drop("x")


@query(f"WITH RECURSIVE {FR}, {TD} SELECT vec_id, node AS code, round(score, 5) AS path_score FROM w WHERE t = 8")
def trie_decode(s):
    """OCR-10, ARR-10."""
    return _decoded(s).select("vec_id", "code", F.round("path_score", 5).alias("path_score"))


@query(f"""WITH RECURSIVE {FR}, {GR}, {TD}, voc(c) AS (VALUES {VOC}), j AS (SELECT vec_id, CASE WHEN node NOT IN (SELECT c FROM voc) AND greedy_code IN (SELECT c FROM voc) THEN greedy_code ELSE node END AS code, greedy_code, conf, score
    FROM w JOIN gr USING (vec_id) WHERE t = 8) SELECT vec_id, code AS final_code, round(CASE WHEN greedy_code = code THEN conf ELSE exp(score / 8) END, 5) AS final_confidence FROM j WHERE code IN (SELECT c FROM voc)""")
def decode_merge_rule(s):
    """OCR-13, OCR-14, MTH-04."""
    return X.keep_confident(X.merge_paths(_decoded(s), TRIE, 8), 0.0).select("vec_id", "final_code", F.round("final_confidence", 5).alias("final_confidence"))


@query("SELECT job, row, col, arg_min(code, (-confidence, l_partkey, l_suppkey, l_extendedprice)) AS code, max(confidence) AS confidence FROM raw_cells GROUP BY 1, 2, 3")
def best_confidence_per_cell(s):
    """WIN-10."""
    return O.latest(s("raw_cells"), O.KEY, F.desc("confidence"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select(*O.KEY, "code", "confidence")


@query("SELECT job, (n - 1) // 3 AS block, count(*) AS cells, least(max(n), 5) AS done FROM (SELECT job, row_number() OVER (PARTITION BY job ORDER BY row, col) AS n FROM cells) x GROUP BY 1, 2")
def chunked_progress(s):
    """WIN-11, OCR-15."""
    return O.chunks(s("cells"), 3, F.lit(5)).withColumn("block", F.col("block").cast("long"))


UPD = "u AS (SELECT job, row, col, row_number() OVER (ORDER BY job, row, col, l_partkey, l_suppkey, l_extendedprice) AS ord, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 997 = 1 THEN 'X99' ELSE 'E' || (l_partkey % 9 + 1) END AS new_code FROM raw_cells)"


def _updates(s: Source) -> tuple[DataFrame, DataFrame]:
    """Updates in an order of their own inside each cell, and those that may be applied."""
    order = F.row_number().over(Window.partitionBy(*O.KEY).orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    code = F.when(F.col("l_partkey") % 4 == 0, " ").when(F.col("l_partkey") % 997 == 1, "x99").otherwise(F.concat(F.lit(" e"), (F.col("l_partkey") % 9 + 1).cast("string")))
    raw = s("raw_cells").select(*O.KEY, order.alias("ord"), code.alias("new_code"))
    bad = R.violations(raw, s("cells"), s("dict"), s.jobs_as_grids())
    return bad, R.accepted(raw, bad)


BADJ = "bad AS (SELECT DISTINCT job FROM u WHERE new_code NOT IN (SELECT code FROM dict) OR job NOT IN (SELECT id FROM jobs))"


@query(f"WITH {UPD}, {BADJ}, f AS (SELECT job, row, col, arg_max(coalesce(new_code, '-'), ord) AS c FROM u WHERE job NOT IN (SELECT job FROM bad) GROUP BY 1, 2, 3) SELECT cells.job, cells.row, cells.col, cells.code, CASE WHEN f.c IS NOT NULL THEN nullif(f.c, '-') ELSE corrected_code END AS corrected_code FROM cells LEFT JOIN f USING (job, row, col)")
def correction_apply(s):
    """COR-01, PRD-08, JON-05."""
    return R.apply(s("cells"), _updates(s)[1]).select(*O.KEY, "code", "corrected_code")


@query(f"WITH {UPD}, {BADJ}, x AS (SELECT u.job, new_code, coalesce(lag(new_code IS NOT NULL) OVER (PARTITION BY u.job, u.row, u.col ORDER BY ord), corrected_code IS NOT NULL) AS had FROM u JOIN cells USING (job, row, col) WHERE u.job NOT IN (SELECT job FROM bad)) SELECT job, count_if(new_code IS NOT NULL) AS corrected, count_if(new_code IS NULL AND had) AS reverted FROM x GROUP BY 1")
def correction_counts(s):
    """COR-01."""
    return R.counts(s("cells"), _updates(s)[1])


@query(f"WITH {UPD} SELECT error, count(*) AS n FROM (SELECT CASE WHEN job NOT IN (SELECT id FROM jobs) THEN NULL WHEN new_code NOT IN (SELECT code FROM dict) THEN 'INVALID_CODE' END AS error FROM u) x WHERE error IS NOT NULL GROUP BY 1")
def error_contract_rows(s):
    """PRD-07, PRD-08."""
    return _updates(s)[0].groupBy("error").agg(F.count("*").alias("n"))


ACC = "count(*) AS n, round(count_if(label = 'BLANK' AND code = label) / greatest(1, count_if(label = 'BLANK')), 6) AS blank_acc, round(count_if(label <> 'BLANK' AND code = label) / greatest(1, count_if(label <> 'BLANK')), 6) AS code_acc, round(count_if(code = label) / greatest(1, count(*)), 6) AS overall"


@query(f"SELECT set_name, {ACC}, round(coalesce(avg(confidence) FILTER (label = 'BLANK'), 0), 6) AS blank_conf, round(coalesce(avg(confidence) FILTER (label <> 'BLANK'), 0), 6) AS code_conf FROM pred GROUP BY 1")
def accuracy_by_set(s):
    """AGG-12, AGG-17."""
    a = E.accuracy(s("pred"), "set_name")
    return a.select("set_name", "n", *(R6(F.col(c)).alias(c) for c in a.columns[2:]))


@query("SELECT set_name, count(*) AS n, round(avg((label = code)::int), 6) AS exact, count_if(confidence >= 0.5) AS accepted, round(count_if(confidence >= 0.5 AND label = code) / nullif(count_if(confidence >= 0.5), 0), 6) AS accepted_acc, round(avg((confidence < 0.5)::int), 6) AS unknown_rate, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.1), 6) AS p10, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.9), 6) AS p90 FROM pred GROUP BY 1")
def baseline_percentiles(s):
    """AGG-13, PRD-15."""
    b = E.baseline(s("pred"), 0.5, "set_name")
    return b.select("set_name", "n", "accepted", *(R6(F.col(c)).alias(c) for c in ("exact", "accepted_acc", "unknown_rate", "mean", "p10", "median", "p90")))


@query("SELECT label, count(*) AS n, round(avg((label = code)::int), 6) AS acc FROM pred GROUP BY 1")
def per_code_accuracy(s):
    """AGG-14, ARR-08."""
    return E.per_code(s("pred")).withColumn("acc", R6(F.col("acc")))


@query("WITH p AS (SELECT label, count(*) AS n, round(avg((label = code)::int), 6) AS acc FROM pred GROUP BY 1) (SELECT *, 'worst' AS side FROM p ORDER BY acc, n DESC, label LIMIT 8) UNION ALL (SELECT *, 'best' FROM p ORDER BY acc DESC, n DESC, label LIMIT 8)")
def worst_best_codes(s):
    """WIN-12; a top-k report."""
    return E.best_and_worst(E.per_code(s("pred")).withColumn("acc", R6(F.col("acc"))), 8)


@query("""WITH t AS (SELECT job, row, col, code AS truth FROM cells WHERE code <> 'BLANK'), p AS (SELECT job, row, col, CASE WHEN (row + col) % 4 = 0 THEN 'Q99' ELSE code END AS code FROM cells WHERE (job + col) % 6 <> 0)
    SELECT t.job, count(*) AS cells, count_if(p.code = truth) AS correct, count_if(p.code IS NOT NULL AND p.code NOT IN (SELECT code FROM dict)) AS invalid, count_if(p.code IS NULL) AS missed, round(count_if(p.code = truth) / count(*), 6) AS exact_rate, round(count_if(p.code IS NOT NULL) / count(*), 6) AS coverage
    FROM t LEFT JOIN p USING (job, row, col) GROUP BY 1""")
def grid_eval(s):
    """AGG-15, AGG-16, JON-10, JON-15, OCR-19."""
    c = s("cells")
    truth = c.filter("code <> 'BLANK'").select(*O.KEY, F.col("code").alias("truth"))
    pred = c.filter("(job + col) % 6 <> 0").select(*O.KEY, F.when((F.col("row") + F.col("col")) % 4 == 0, "Q99").otherwise(F.col("code")).alias("code"))
    g = E.grid_scores(truth, pred, s("dict"), "job")
    return g.withColumns({c: R6(F.col(c)) for c in ("exact_rate", "coverage")})


@query(f"""WITH c AS (SELECT set_name, {ACC} FROM pred WHERE id % 3 <> 0 GROUP BY 1), p AS (SELECT set_name, {ACC} FROM pred GROUP BY 1), u AS (SELECT set_name, 'blank_acc' AS metric, c.blank_acc - p.blank_acc AS delta FROM c JOIN p USING (set_name)
    UNION ALL SELECT set_name, 'code_acc', c.code_acc - p.code_acc FROM c JOIN p USING (set_name) UNION ALL SELECT set_name, 'overall', c.overall - p.overall FROM c JOIN p USING (set_name)) SELECT set_name, metric, round(delta, 6) AS delta, round(delta, 9) < -0.005 AS fails FROM u""")
def regression_gate(s):
    """JON-11, GAT-01, GAT-02."""
    acc = lambda df: (lambda a: a.select("set_name", *(R6(F.col(c)).alias(c) for c in ("blank_acc", "code_acc", "overall"))))(E.accuracy(df, "set_name"))
    return E.gate(acc(s("pred").filter("id % 3 <> 0")), acc(s("pred"))).withColumn("delta", R6(F.col("delta")))


@query("SELECT count(*) AS n, round(max(list_max(list_transform(embedding, lambda x: abs(x::double - round(x::double, 2))))), 6) AS max_diff, round(avg(list_avg(list_transform(embedding, lambda x: abs(x::double - round(x::double, 2))))), 6) AS mean_diff FROM embeddings")
def parity_max_diff(s):
    """AGG-32, GAT-03, OCR-25."""
    v = F.col("embedding").cast("array<double>")
    p = s.table("embeddings").select(v.alias("a"), F.transform(v, lambda x: F.round(x, 2)).alias("b"))
    d = E.parity(p, "a", "b")
    return d.select("n", R6(F.col("max_diff")).alias("max_diff"), R6(F.col("mean_diff")).alias("mean_diff"))


@query("SELECT job, row, col, CASE WHEN confidence >= 0.9 THEN code END AS code, CASE WHEN confidence >= 0.9 THEN 'auto' ELSE 'needs_manual' END AS source FROM (SELECT g.id AS job, r.row, k.col, c.code, c.confidence FROM jobs g CROSS JOIN (SELECT unnest(range(7)) AS row) r CROSS JOIN (SELECT unnest(range(8)) AS col) k LEFT JOIN cells c ON c.job = g.id AND c.row = r.row AND c.col = k.col) x")
def ground_truth_build(s):
    """PRD-16."""
    return E.truth_from_predictions(O.positions(s.jobs_as_grids()), s("cells").select(*O.KEY, "code", "confidence"))


HASH = "(id * 2654435761 + 20260809) % 2147483648"
SEED = 20260809


@query(f"SELECT id, code, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY {HASH}, id) <= CASE WHEN count(*) OVER (PARTITION BY code) >= 2 THEN greatest(1, round_even(count(*) OVER (PARTITION BY code) * 0.2::double, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM samples")
def stratified_split(s):
    """WIN-07, AGG-28."""
    return D.stratified_split(s("samples"), 0.2, SEED).select("id", "code", "split")


@query(f"SELECT id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {HASH}, id) <= floor(count(*) OVER (PARTITION BY source) * 0.9::double) THEN 'train' ELSE 'val' END AS split FROM samples")
def seeded_cut(s):
    """SMP-02."""
    return D.cut(s("samples"), 0.1, SEED, "id", "source").select("id", "split")


@query(f"SELECT id, code, source FROM (SELECT *, code = 'A1' AND source = 'src5' AS hit, row_number() OVER (PARTITION BY code = 'A1' AND source = 'src5' ORDER BY {HASH}, id) AS n FROM samples) x WHERE NOT hit OR n <= 2")
def blank_cap(s):
    """WIN-08; the cap is the operator."""
    return D.cap(s("samples"), "A1", "src5", 2, SEED).select("id", "code", "source")


@query("SELECT source, kind, count(*) AS n FROM samples WHERE source NOT IN ('src1', 'src2') GROUP BY 1, 2")
def dataset_union_exclude(s):
    """SET-01, SET-04, PAL-14, PAL-15."""
    a = s("samples")
    out = s.spark.createDataFrame([("src1",), ("src2",)], "source string")
    return D.assemble(a.filter("kind = 'real'").drop("kind"), a.filter("kind = 'synth'").drop("kind"), out).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count_if(kind = 'real') AS real, count_if(kind = 'synth') AS synth, count(DISTINCT code) AS codes, count_if(code = 'BLANK') AS blank, round_even(count_if(kind = 'synth') / greatest(1, count_if(kind = 'real')), 3) AS ratio FROM samples")
def dataset_audit(s):
    """AGG-19, AGG-20, AGG-22."""
    return D.audit(s("samples"))


@query("""WITH w AS (SELECT id, (CASE WHEN kind = 'real' THEN 1.0 WHEN max((kind = 'real')::int) OVER (PARTITION BY code) = 0 THEN 1.5 ELSE 0.5 END)::double / count(*) OVER (PARTITION BY code) AS w FROM samples) SELECT id, round(w * (SELECT count(*) FROM w) / (SELECT sum(w) FROM w), 6) AS weight FROM w""")
def sampling_weights(s):
    """SMP-01, AGG-28."""
    return D.sampling_weights(s("samples"), 1.0, 0.5).select("id", R6(F.col("weight")).alias("weight"))


@query("SELECT CASE WHEN lang IN ('de', 'en') THEN lang ELSE 'unknown' END AS level, count(*) AS n FROM documents GROUP BY 1")
def quality_level_hist(s):
    """AGG-21, ARR-09."""
    return D.level_counts(s.table("documents"), F.col("lang"), ["de", "en"])


@query(f"WITH u AS (SELECT id, {HASH} / 2147483648.0::double AS u FROM samples) SELECT CASE WHEN u < 0.55 THEN 'clean' WHEN u < 0.55::double + 0.30::double THEN 'light' WHEN u < 0.55::double + 0.30::double + 0.13::double THEN 'medium' ELSE 'heavy' END AS level, count(*) AS n FROM u GROUP BY 1")
def quality_draw(s):
    """PAL-11, PAL-19."""
    return s("samples").groupBy(D.draw(D.unit(F.col("id"), SEED), D.QUALITY_LEVELS).alias("level")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT DISTINCT unnest(string_split(code, '')) AS ch FROM cells) SELECT ch, cast(row_number() OVER (ORDER BY regexp_matches(ch, '[0-9]'), ch) AS int) AS idx FROM c UNION ALL SELECT '<blank>', 0")
def vocab_derive(s):
    """AGG-30, SET-02."""
    return D.vocabulary(s("cells").select("code"))


@query("SELECT code, list_transform(string_split(code, ''), lambda c: coalesce(nullif(instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', c), 0), -1))::varchar AS idx FROM dict")
def token_indices(s):
    """STR-09, ARR-06."""
    idx = C.token_indices(F.col("code"), ["<blank>", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
    return s("dict").select("code", F.concat(F.lit("["), F.array_join(F.transform(idx, lambda x: x.cast("string")), ", "), F.lit("]")).alias("idx"))


@query(f"SELECT id, chr((65 + {HASH} % 26)::int) || (1 + ({HASH} // 26) % 99) AS code FROM samples")
def random_codes(s):
    """STR-17, PAL-18, SMP-03."""
    return s("samples").select("id", D.random_code(F.col("id"), SEED).alias("code"))


@query("SELECT p.code, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY code) - 1 AS n, code FROM dict) p JOIN (SELECT doc_id % (SELECT count(*) FROM dict) AS n FROM documents) d USING (n) GROUP BY 1")
def code_pool(s):
    """PAL-09, PAL-13."""
    codes = s("dict").select((F.row_number().over(Window.orderBy("code")) - 1).alias("n"), "code")
    return D.pool(codes, s.table("documents").select(F.col("doc_id").alias("pos"))).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT code, count(*) AS n, max(id) AS last FROM samples GROUP BY 1")
def per_code_index(s):
    """WIN-09, SNK-16: the index counts up to the code's rows."""
    i = D.per_code_index(s("samples"))
    return i.groupBy("code").agg((F.max("index") + 1).cast("long").alias("n"), F.max_by("id", "index").alias("last"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS version FROM events")
def time_stamps(s):
    """DAT-01 to DAT-04."""
    e = s.table("events").withColumn("back", C.parse_stamp(C.iso_stamp(F.col("ts"))))
    return e.select("event_id", C.iso_stamp(F.col("ts")).alias("iso"), C.date_stamp(F.col("ts")).alias("day"), C.version_stamp(F.col("back").cast("timestamp_ntz")).alias("version"))


@query("SELECT 'v' || (max(try_cast(regexp_extract(source, 'src([0-9]+)', 1) AS bigint)) + 1) AS next FROM documents")
def next_version_name(s):
    """AGG-31, STR-18, PRD-18."""
    return s.table("documents").agg(C.next_version(F.col("source"), "src([0-9]+)", "v").alias("next"))


STEP = """o AS (SELECT *, coalesce(sum((kind = 'failed')::int) OVER b, 0) AS pf, coalesce(max((kind = 'completed')::int) OVER b, 0) AS pd FROM steps WINDOW b AS (PARTITION BY job ORDER BY attempt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), live AS (SELECT * FROM o WHERE pf <= 2 AND pd = 0)"""


@query(f"WITH {STEP} SELECT job, CASE WHEN count_if(kind = 'completed') > 0 THEN 'SUCCEEDED' WHEN count_if(kind = 'failed') > 2 THEN 'FAILED' WHEN count_if(kind IN ('progress', 'failed')) > 0 THEN 'PROCESSING' ELSE 'PENDING' END AS status, coalesce(max(processed) FILTER (kind IN ('progress', 'completed')), 0) AS processed FROM live GROUP BY 1")
def lifecycle_final_state(s):
    """STM-01, STM-02, AGG-03."""
    return S.replay(s("steps")).select("job", "status", "processed")


@query(f"WITH {STEP} SELECT job, least(count_if(kind = 'failed'), 2)::int AS attempt, least(count_if(kind = 'failed'), 2)::int AS retry_count FROM live GROUP BY 1")
def retry_state(s):
    """STM-03."""
    return S.replay(s("steps")).select("job", "attempt", "retry_count")


@query("SELECT event_id, (event_id % 4) * 10000 + event_id % 10000 AS key FROM events")
def event_order_key(s):
    """STM-06."""
    return s.table("events").select("event_id", S.order_key(F.col("event_id") % 4, F.col("event_id") % 10000).alias("key"))


@query("SELECT id, CASE WHEN status = 'PENDING' AND m IS NOT NULL THEN 'PROCESSING' ELSE status END AS status, greatest(processed_cells, coalesce(m, 0)) AS processed FROM jobs LEFT JOIN (SELECT job, max(row * 8 + col) AS m FROM cells GROUP BY 1) c ON c.job = jobs.id")
def progress_reconcile(s):
    """AGG-03, AGG-04, STM-02."""
    jobs = s("jobs").select(F.col("id").alias("job"), "status", F.col("processed_cells").alias("processed"))
    reports = s("cells").select("job", (F.col("row") * 8 + F.col("col")).alias("processed"))
    return S.progress(jobs, reports).select(F.col("job").alias("id"), "status", "processed")


@query("SELECT id, CASE WHEN status = 'PENDING' THEN CASE WHEN id % 3 = 2 THEN 'FAILED' ELSE 'PROCESSING' END ELSE status END AS status, (id % 3 + (status = 'PENDING' AND id % 3 < 2)::int)::int AS retry_count FROM jobs")
def restart_recovery(s):
    """STM-04, SRC-02."""
    jobs = s("jobs").withColumns({"status": F.when(F.col("status") == "PENDING", "PROCESSING").otherwise(F.col("status")), "retry_count": (F.col("id") % 3).cast("int"), "attempt": (F.col("id") % 3).cast("int")})
    return S.recover(jobs).select("id", "status", "retry_count")


@query("SELECT user_id AS job, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def idempotent_dedupe(s):
    """STM-05: every event delivered twice counts once."""
    twice = s("steps").unionByName(s("steps"))
    return twice.dropDuplicates(["job", "attempt", "seq"]).groupBy("job").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


from gridloom.plans import stored, stores  # noqa: E402, F401  register their queries here
