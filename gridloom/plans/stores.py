"""More queries of the reference's operators: stored rows, joins of blueprints, pixels, and files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import codes as C
from gridloom.operators import cells as O
from gridloom.operators import datasets as D
from gridloom.operators import decode as X
from gridloom.operators import dictionary as L
from gridloom.operators import evaluation as E
from gridloom.operators import jobs as J
from gridloom.operators import palette as P
from gridloom.operators import pixels as I
from gridloom.plans.queries import CHARS, EMB, FR, HASH, NAT, R6, RGB, SEED, TD, TRIE, query
from gridloom.plans.surrogate import Source
from gridloom.sources import readers, sinks
from gridloom.sources.scratch import folder


@query("""SELECT id, (100 + id % 50)::bigint AS width, CASE WHEN id % 3 = 0 THEN 2 END::int AS n_codes, strftime(created_at, '%Y%m%d') AS day, id % 2 = 0 AS beats, rows FROM jobs""")
def job_rows_decoded(s):
    """PRJ-01, STM-08, DAT-02, DAT-03: JSON and stamps as text; absent and unreadable ones become NULL."""
    stamp = C.iso_stamp(F.col("created_at"))
    raw = s("jobs").select(
        "id", F.format_string('{"x":1,"y":2,"width":%d,"height":9}', 100 + F.col("id") % 50).alias("crop_box"), F.when(F.col("id") % 3 == 0, '["A1","B2"]').when(F.col("id") % 3 == 1, "not json").alias("valid_codes"),
        stamp.alias("created_at"), F.when(F.col("id") % 2 == 0, stamp).alias("heartbeat_at"), F.col("rows").cast("string").alias("rows"), F.col("rows").cast("int").alias("expected"),
    )
    day = C.date_stamp(F.col("created_at").cast("timestamp_ntz"))
    return J.decode(raw).select("id", F.col("crop_box.width").alias("width"), F.nullif(F.size("valid_codes"), F.lit(-1)).alias("n_codes"), day.alias("day"), F.col("heartbeat_at").isNotNull().alias("beats"), F.col("rows").cast("int").alias("rows"))


@query("SELECT job, row, col, CASE WHEN col % 4 = 0 THEN 'MAPPED' WHEN col % 4 = 1 THEN 'BLANK' END AS status, CASE WHEN row % 2 = 0 THEN confidence::double END AS confidence, job % 5 = 0 AS corrected FROM cells")
def cell_rows_decoded(s):
    """PRJ-02."""
    state = F.when(F.col("col") % 4 == 0, "MAPPED").when(F.col("col") % 4 == 1, "BLANK").when(F.col("col") % 4 == 2, "NOPE")
    raw = s("cells").select(
        "job", F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), state.alias("status"), F.when(F.col("row") % 2 == 0, F.col("confidence").cast("string")).otherwise("?").alias("confidence"),
        F.when(F.col("job") % 5 == 0, "2026-01-02T03:04:05.000000+00:00").alias("corrected_at"),
    )
    return O.decode(raw).select(*O.KEY, "status", "confidence", F.col("corrected_at").isNotNull().alias("corrected"))


@query("SELECT l_orderkey AS job, l_linenumber, l_partkey, l_suppkey, l_extendedprice, upper('e' || (l_partkey % 7)::varchar) AS code, round(l_quantity / 150.0::double, 4) AS confidence FROM lineitem")
def result_rows(s):
    """PRJ-07."""
    code, confidence = C.result_row(F.concat(F.lit("e"), (F.col("l_partkey") % 7).cast("string")), F.col("l_quantity") / 150.0)
    return s.table("lineitem").select(F.col("l_orderkey").alias("job"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", code.alias("code"), confidence.alias("confidence"))


@query("SELECT ord, code AS printed FROM dict_raw")
def render_codes(s):
    """PRJ-10: two brands' codes carry a prefix in the library, one of them in part of its codes only."""
    raw = s("dict_raw")
    held = F.when(F.col("brand") == "Brand#11", F.concat(F.lit("COCO-"), "code")).when((F.col("brand") == "Brand#22") & (F.col("ord") % 2 == 0), F.concat(F.lit("M-"), "code")).otherwise(F.col("code"))
    return raw.select("ord", C.render_code(held, F.col("brand"), {"Brand#11": "COCO-", "Brand#22": "M-"}).alias("printed"))


@query("SELECT DISTINCT code FROM cells ORDER BY code")
def distinct_codes(s):
    """SET-06, SRC-08."""
    return O.distinct_sorted(s("cells"), "code")


@query(f"SELECT code, ((row_number() OVER (ORDER BY {NAT}) - 1) // 100 + 1)::int AS page FROM dict")
def all_pages(s):
    """SRT-10."""
    return O.pages(s("dict").select("code"), 100, C.natural_key(F.col("code")))


@query(f"SELECT code, r, g, b FROM (SELECT code, {RGB}, substr(code, 2)::int % 5 AS k FROM dict) x WHERE k < 3")
def redraw_colours(s):
    """PAL-22: colours without # or cut short are not drawn with."""
    k = F.substr("code", F.lit(2)).cast("int") % 5
    hex_ = F.when(k == 3, F.substr("hex", F.lit(2))).when(k == 4, F.substr("hex", F.lit(1), F.lit(6))).otherwise(F.col("hex"))
    return P.redraw_colours(s("dict").select("code", hex_.alias("hex")))


@query("SELECT job, row, col, code FROM cells WHERE job = 7 AND row = 1 AND col = (SELECT min(col) FROM cells WHERE job = 7 AND row = 1)")
def cell_point_lookup(s):
    """SRC-01, SRC-04."""
    first = s("cells").filter("job = 7 AND row = 1").agg(F.min("col")).first()[0]
    return J.get_by_key(s("cells").select(*O.KEY, "code"), job=7, row=1, col=first)


@query("SELECT code, (length(code) <= 8 AND (code = 'BLANK' OR code IN ('E1', 'E2', 'L10', 'S5'))) AS allowed, count(*) AS n FROM cells GROUP BY 1, 2")
def editor_validity(s):
    """PRD-21: the input is raised to capitals first."""
    typed = F.upper(F.lower("code"))
    return s("cells").groupBy("code", C.correction_allowed(typed, F.array(*map(F.lit, ["E1", "E2", "L10", "S5"]))).alias("allowed")).agg(F.count("*").alias("n"))


@query("SELECT status, status IN ('SUCCEEDED', 'FAILED') AS terminal, count(*) AS n FROM jobs GROUP BY 1, 2")
def terminal_states(s):
    """PRD-22."""
    return s("jobs").groupBy("status", C.is_terminal(F.col("status")).alias("terminal")).agg(F.count("*").alias("n"))


def _blueprints(s: Source) -> DataFrame:
    return s("jobs").filter("status = 'SUCCEEDED'").select(F.concat(F.lit("bp"), "id").alias("blueprint_id"), F.col("id").alias("job"), "rows", "cols")


def _blueprint_cells(s: Source) -> DataFrame:
    return s("cells").select(F.concat(F.lit("bp"), "job").alias("blueprint_id"), "row", "col", "code", "corrected_code")


@query("SELECT 'bp' || id AS blueprint_id, 'images/' || id || '.png' AS input_image_path FROM jobs WHERE status = 'SUCCEEDED'")
def blueprint_image_paths(s):
    """JON-03."""
    return J.image_path(_blueprints(s), s("jobs").withColumn("input_image_path", F.concat(F.lit("images/"), "id", F.lit(".png"))))


@query("SELECT 'bp' || id AS blueprint_id, c.row, c.col, c.code, c.corrected_code FROM jobs JOIN cells c ON c.job = id WHERE status = 'SUCCEEDED' AND corrected_code IS NOT NULL")
def corrected_blueprint_cells(s):
    """JON-04."""
    return J.corrected_cells(_blueprints(s), _blueprint_cells(s)).select("blueprint_id", "row", "col", "code", "corrected_code")


@query("SELECT 'bp' || id AS blueprint_id, jobs.rows, string_agg(c.code, ',' ORDER BY c.row, c.col) AS codes FROM jobs LEFT JOIN cells c ON c.job = id WHERE status = 'SUCCEEDED' GROUP BY 1, 2")
def blueprint_in_row_order(s):
    """JON-02, SRT-05."""
    found = J.blueprint_detail(_blueprints(s), _blueprint_cells(s))
    return found.select("blueprint_id", "rows", F.array_join(F.transform("cells", lambda c: c["code"]), ",").alias("codes"))


@query("SELECT l.job, l.pos::int AS pos, d.code, d.hex FROM (SELECT id AS job, unnest(['E1', 'NOPE', 'S' || (id % 50 + 1), 'L7']) AS code, unnest(range(4)) AS pos FROM jobs) l JOIN dict d ON d.code = l.code")
def valid_codes_with_colours(s):
    """JON-08."""
    codes = F.array(F.lit("E1"), F.lit("NOPE"), F.concat(F.lit("S"), (F.col("id") % 50 + 1).cast("string")), F.lit("L7"))
    return L.in_list_order(s("jobs").select(F.col("id").alias("job"), codes.alias("codes")), s("dict")).select("job", "pos", "code", "hex")


@query("SELECT id, label, code FROM (SELECT * FROM pred ORDER BY id, label, confidence) x WHERE label <> code ORDER BY id, label, confidence LIMIT 20")
def first_mismatches(s):
    """AGG-29; a top-k report."""
    return E.mismatches(s("pred"), 20).select("id", "label", "code")


@query("WITH a AS (SELECT set_name AS name, round(avg((label = code)::int), 6) AS overall FROM pred GROUP BY 1) SELECT name, overall, cast(row_number() OVER (ORDER BY overall DESC, name) AS int) AS place FROM a")
def checkpoint_ranking(s):
    """SRT-09."""
    a = E.accuracy(s("pred"), "set_name").select(F.col("set_name").alias("name"), R6(F.col("overall")).alias("overall"))
    return E.rank_checkpoints(a, "overall")


@query(f"SELECT code, name FROM dict ORDER BY {NAT} LIMIT 25 OFFSET 50")
def viewport_rows(s):
    """SRT-11: what a view with two screens on either side shows; the window is the operator."""
    return O.page(s("dict").select("code", "name"), 3, 25, C.natural_key(F.col("code")))


@query(f"SELECT id, code FROM samples ORDER BY {HASH}, id LIMIT 50")
def shuffled_head(s):
    """SRT-12; the cut is the operator."""
    return D.shuffled_head(s("samples"), 50, SEED).select("id", "code")


@query("SELECT job, row, col, code || '_r' || (row + 1) || '_c' || (col + 1) || '_h' || (job % 360) || '_v' || (job % 256) || '.png' AS file FROM cells")
def export_names(s):
    """STR-07."""
    return s("cells").select(*O.KEY, C.export_name(F.col("code"), F.col("row"), F.col("col"), F.col("job") % 360, F.col("job") % 256).alias("file"))


@query(f"WITH RECURSIVE {FR}, {TD} SELECT vec_id, node AS code, round(exp(score / greatest(1, length(node))), 5) AS confidence FROM w WHERE t = 8")
def legacy_confidence(s):
    """MTH-05."""
    got = X.constrained(s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 8, X.Trie(TRIE, CHARS))
    return got.select("vec_id", "code", F.round(X.legacy_confidence(F.col("path_score"), F.col("code")), 5).alias("confidence"))


OLD = TD.replace("b.s > lf.l[1]", "b.s > lf.l[1] - 2.0").replace("emit AND NOT (w.live AND b.ch = w.last)", "emit")


@query(f"WITH RECURSIVE {FR}, {OLD} SELECT vec_id, node AS code, round(score, 5) AS path_score FROM w WHERE t = 8")
def trie_decode_with_penalty(s):
    """OCR-11."""
    x = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return X.constrained(x, "x", 8, X.Trie(TRIE, CHARS), penalty=2.0, collapse=False).select("vec_id", "code", F.round("path_score", 5).alias("path_score"))


@query("SELECT code, CASE WHEN substr(code, 1, 1) = 'E' THEN 'new' ELSE name END AS name FROM dict UNION ALL SELECT 'ZZ9', 'new'")
def dictionary_upsert(s):
    """SNK-01."""
    d = s("dict").select("code", "name")
    new = d.filter("code LIKE 'E%'").select("code", F.lit("new").alias("name")).unionByName(s.spark.createDataFrame([("ZZ9", "new")], "code string, name string"))
    return O.upsert(d, new, ["code"])


@query("SELECT job, row, col, CASE WHEN row_number() OVER (PARTITION BY job ORDER BY ((row * 1000 + col) * 2654435761 + 20260809) % 2147483648, row, col) <= floor(count(*) OVER (PARTITION BY job) * 0.3::double) THEN 'BLANK' ELSE code END AS code FROM cells")
def blanked_boards(s):
    """PAL-10."""
    return D.blank_out(s("cells").select(*O.KEY, "code"), 0.3, SEED)


IMG = ", ".join(EMB.format(i + 1) for i in range(48))
AT = lambda y, x, c: f"p[{(y * 4 + x) * 3 + c + 1}]"


def _images(s: Source) -> DataFrame:
    """Images of 4 x 4 pixels as PNG."""
    v = F.transform(F.slice("embedding", 1, 48), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.abs(x) * 255).cast("int"))))
    return I.as_png(s.table("embeddings").select(F.col("vec_id").alias("id"), v.alias("pixels")), 4, 4)


def _measured(s: Source, what: str) -> DataFrame:
    got = I.measured(_images(s).withColumn("variant", F.lit("orig")), what)
    weigh = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return got.select("id", F.size("values").alias("n"), R6(weigh).alias("weighed"))


def _weighed(parts: list[str]) -> str:
    return f"WITH i AS (SELECT vec_id AS id, [{IMG}] AS p FROM embeddings) SELECT id, {len(parts)}::int AS n, round(({' + '.join(f'{k + 1} * ({x})' for k, x in enumerate(parts))})::double, 6) AS weighed FROM i"


@query(_weighed([AT(y, x, c) for y in range(1, 3) for x in range(1, 4) for c in range(3)]))
def png_crop(s):
    """OCR-06, SRC-19, SNK-13: images written as PNG, decoded, cropped with bounds clamped."""
    return _measured(s, "crop")


@query(_weighed([f"({AT(2 * y, 2 * x, c)} + {AT(2 * y, 2 * x + 1, c)} + {AT(2 * y + 1, 2 * x, c)} + {AT(2 * y + 1, 2 * x + 1, c)}) / 4.0::double" for y in range(2) for x in range(2) for c in range(3)]))
def area_resample(s):
    """OCR-07: exact box averages."""
    return _measured(s, "area")


@query(_weighed([f"floor({AT(y, x, 0)} * 0.299::double + {AT(y, x, 1)} * 0.587::double + {AT(y, x, 2)} * 0.114::double)" for y in range(4) for x in range(4)]))
def gray_values(s):
    """COL-09."""
    return _measured(s, "gray")


@query(_weighed([f"{AT(y // 2, x // 2, c)} / 255.0::double" for c in range(3) for y in range(8) for x in range(8)]).replace(", 6) AS weighed", ", 2) AS weighed"))
def letterbox_tensor(s):
    """OCR-01, OCR-08, OCR-20, ARR-05: channels first, in 0 to 1, in single precision."""
    return _measured(s, "tensor").withColumn("weighed", F.round("weighed", 2))


VAR = " UNION ALL ".join(
    f"SELECT id, '{name}' AS variant, 48::int AS n, ({' + '.join(f'{k + 1} * ' + of(k) for k in range(48))})::double AS weighed FROM i"
    for name, of in (
        ("orig", lambda k: f"p[{k + 1}]"),
        ("flip", lambda k: f"p[{(k // 12) * 12 + (3 - k // 3 % 4) * 3 + k % 3 + 1}]"),
        ("scale_08", lambda k: f"least(255, round_even(p[{k + 1}] * 0.8::double, 0))"),
        ("scale_12", lambda k: f"least(255, round_even(p[{k + 1}] * 1.2::double, 0))"),
    )
)


@query(f"WITH i AS (SELECT vec_id AS id, [{IMG}] AS p FROM embeddings) {VAR} UNION ALL SELECT id, unnest(['rot_m10', 'rot_p10', 'blur']), 48::int, NULL::double FROM i")
def image_variants(s):
    """PAL-17: all seven variants; the sums of those that SQL can state."""
    got = I.measured(I.variants(_images(s)), "pixels")
    weigh = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return got.select("id", "variant", F.size("values").alias("n"), F.when(F.col("variant").isin("orig", "flip", "scale_08", "scale_12"), weigh).alias("weighed"))


@query(f"""WITH px AS (SELECT vec_id AS job, k // 6 AS row, k % 3 AS col, k, {', '.join(EMB.format(f'k * 3 + {i + 1}') + f' AS {c}' for i, c in enumerate('rgb'))} FROM embeddings CROSS JOIN (SELECT unnest(range(18)) AS k) x),
    h AS (SELECT job, row, col, r // 16 AS br, g // 16 AS bg, b // 16 AS bb, count(*) AS n, round_even(avg(r), 0)::int AS r, round_even(avg(g), 0)::int AS g, round_even(avg(b), 0)::int AS b FROM px GROUP BY ALL),
    t AS (SELECT job, row, col, arg_min(r, (-n, br, bg, bb)) AS r, arg_min(g, (-n, br, bg, bb)) AS g, arg_min(b, (-n, br, bg, bb)) AS b FROM h GROUP BY 1, 2, 3), p AS (SELECT code, {RGB} FROM dict),
    q AS (SELECT t.job, t.row, t.col, p.code, (t.r - p.r) * (t.r - p.r) + (t.g - p.g) * (t.g - p.g) + (t.b - p.b) * (t.b - p.b) AS d2 FROM t CROSS JOIN p)
    SELECT job, row::int AS row, col::int AS col, arg_min(code, (d2, code)) AS code FROM q GROUP BY 1, 2, 3""")
def board_generated(s):
    """PAL-07 at a threshold of 0, where no colours merge (merging: frequency_merge)."""
    v = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.abs(F.get("embedding", k)) * 255).cast("int")))
    px = s.table("embeddings").select(F.col("vec_id").alias("job"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("k"))
    px = px.select("job", F.floor(F.col("k") / 6).cast("int").alias("row"), (F.col("k") % 3).alias("col"), *(v(F.col("k") * 3 + i).alias(c) for i, c in enumerate("rgb")))
    return P.generate_board(px, s("dict"), 0.0).select("job", "row", "col", "code")


@query("SELECT job, count(*) AS n, true AS within, true AS one_offset FROM cells GROUP BY 1")
def board_cell_crops(s):
    """PAL-08, PAL-13: crops of a board are moved together, 8 pixels at most either way."""
    c = P.board_crops(s("cells").select(*O.KEY, "code"), SEED)
    dx, dy = F.col("x") - F.col("col") * 48, F.col("y") - F.col("row") * 48
    bound = (F.abs(dx) <= 8) & (F.abs(dy) <= 8) & (F.col("w") == 48) & (F.col("h") == 48)
    return c.groupBy("job").agg(F.count("*").alias("n"), F.bool_and(bound).alias("within"), ((F.min(dx) == F.max(dx)) & (F.min(dy) == F.max(dy))).alias("one_offset"))


@query("SELECT job, code, 'b' || job || '_r' || lpad((row + 1)::varchar, 3, '0') || '_c' || lpad((col + 1)::varchar, 3, '0') || '_' || code || '.png' AS file, row + 1 AS row, col + 1 AS col FROM cells")
def corpus_manifest(s):
    """PAL-12."""
    return P.corpus_manifest(P.board_crops(s("cells").select(*O.KEY, "code"), SEED))


@query("SELECT job, code, code || '_r' || (row + 1) || '_c' || (col + 1) || '_h0_v9.png' AS file, row + 1 AS row, col + 1 AS col, 3::bigint AS size FROM cells WHERE corrected_code IS NOT NULL")
def corrections_archive(s):
    """SNK-09, SRC-11, JON-09: archives of each job's corrected cells, read again by their manifests."""
    name = C.export_name(F.col("code"), F.col("row"), F.col("col"), F.lit(0), F.lit(9))
    c = s("cells", by="job").filter("corrected_code IS NOT NULL").select(*O.KEY, "code", name.alias("file"), F.lit(0).alias("hue"), F.lit(9).alias("brightness"), F.lit(b"png").alias("png"))
    return I.archive_lines(I.export_corrections(c))


@query("SELECT code, name, substr(hex, 2) AS hex, brand, 'v7' AS version FROM dict")
def seed_round_trip(s):
    """SRC-05, SRC-06, SNK-11: a dictionary as one JSON array, one name for each column in turn, read as a seed."""
    e = s("dict").select("code", F.when(F.col("code") < "M", F.col("name")).alias("name"), F.when(F.col("code") >= "M", F.col("name")).alias("color_name"), F.col("hex").alias("color_hex"), "brand")
    path = folder(s.spark, "seed")
    e.agg(F.to_json(F.collect_list(F.struct(*e.columns))).alias("value")).write.text(path)  # a dictionary is one document
    return readers.color_seed(s.spark, path, "v7")


@query("SELECT code, file, row::int AS row, col::int AS col, hue, 9::int AS brightness FROM (SELECT *, code || '_' || job || '.png' AS file, '#' || lpad(job::varchar, 6, '0') AS hue FROM cells) x")
def manifest_round_trip(s):
    """SNK-10, SRC-14."""
    path, id_ = folder(s.spark, "manifest"), F.col("job").cast("string")
    sinks.write_manifest(s("cells").select("code", F.concat("code", F.lit("_"), id_, F.lit(".png")).alias("file"), "row", "col", F.concat(F.lit("#"), F.lpad(id_, 6, "0")).alias("hue"), F.lit(9).alias("brightness")), path)
    return readers.manifest(s.spark, path)


@query("SELECT code, count(*) * 2 AS n FROM cells GROUP BY 1")
def append_and_compact(s):
    """SNK-12, SNK-08: rows appended twice, then the same rows in one file."""
    path, to = folder(s.spark, "appended"), folder(s.spark, "compact")
    for _ in range(2):
        sinks.append(s("cells").select("job", "code"), path)
    sinks.compact(s.spark, path, to, 1)
    return readers.table(s.spark, to, "job long, code string").groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT '{\"charset\": \"AB\", \"name\": \"bead\", \"version\": \"v' || count(*) || '\"}' AS manifest, (count(*) % 100)::int AS size FROM lineitem")
def model_publish(s):
    """SNK-14, SNK-15, SNK-18: a version named by the table's rows; a second publication of it fails, the pointer leads to the first."""
    base, n = folder(s.spark, "models"), s.table("lineitem").count()
    about = sinks.merge_manifest({"charset": "AB", "name": "old"}, {"name": "bead", "version": f"v{n}"})
    sinks.publish(s.spark, b"w" * (n % 100), about, base, f"{base}/active")
    try:
        sinks.publish(s.spark, b"other", about, base, f"{base}/active")
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e) and "already exists" not in str(e):
            raise
    active = s.spark.read.parquet(f"{base}/active").first()["active"]
    return s.spark.read.parquet(active).select("manifest", F.octet_length("model").alias("size"))
