"""Queries of the reference's operators that commit to a store, draw samples or follow files, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import codes as C
from gridloom.operators import cells as O
from gridloom.operators import datasets as D
from gridloom.operators import evaluation as E
from gridloom.operators import pixels as I
from gridloom.operators import synth as Y
from gridloom.plans import stores
from gridloom.plans.queries import EMB, HASH, RGB, SEED, ST, query
from gridloom.plans.surrogate import Source
from gridloom.sources import readers, sinks
from gridloom.sources.scratch import folder
from gridloom.sources.store import CellStore

#: rows of lineitem as three deliveries of recognised cells
DELIVERED = "r AS (SELECT job, row, col, code, confidence::double AS confidence, cast(round(l_extendedprice * 100) AS bigint) AS pos, l_suppkey % 3 AS batch FROM raw_cells)"
STAGED = f"{DELIVERED}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, row, col ORDER BY batch DESC, pos DESC, confidence DESC, code DESC) AS n FROM r) x WHERE n = 1)"


def _filled(s: Source) -> CellStore:
    """The store after the three deliveries, one of them sent twice."""
    store = CellStore(s.spark, folder(s.spark, "cells"))
    rows = s("raw_cells").select("job", "row", "col", "code", F.col("confidence").cast("double").alias("confidence"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("pos"), (F.col("l_suppkey") % 3).alias("batch"))
    for batch in (0, 1, 1, 2):
        store.apply_cells(rows.filter(F.col("batch") == batch).drop("batch"), batch)
    return store


@query(f"WITH {STAGED} SELECT job, row, col, code, confidence FROM s")
def store_cells(s):
    """SNK-03: staged cells read back after three committed batches and a replay."""
    return _filled(s).staged().select(*O.KEY, "code", "confidence")


@query(f"""WITH {STAGED}, w AS (SELECT job, count(*) >= any_value(job % 4 + 2) AS whole FROM s GROUP BY 1)
    SELECT s.job, s.row, s.col, s.code, CASE WHEN w.whole THEN 'blueprint' ELSE 'staged' END AS place FROM s JOIN w ON w.job = s.job""")
def store_blueprints(s):
    """SNK-04, SNK-08: jobs with enough cells become blueprints and leave the staging in one commit; a replay and a compaction change nothing."""
    store = _filled(s)
    jobs = s("jobs").select("id", "rows", "cols", (F.col("id") % 4 + 2).alias("total_cells"))
    store.complete(jobs, 0)
    store.complete(jobs, 0)
    store.compact()
    done = store.blueprint_cells().join(store.blueprints().select("blueprint_id", "job"), "blueprint_id")
    cols = [*O.KEY, "code"]
    return done.select(*cols, F.lit("blueprint").alias("place")).unionByName(store.staged().select(*cols, F.lit("staged").alias("place")))


WEIGHTS = """w0 AS (SELECT id, (CASE WHEN kind = 'real' THEN 1.0 WHEN max((kind = 'real')::int) OVER (PARTITION BY code) = 0 THEN 1.5 ELSE 0.5 END)::double / count(*) OVER (PARTITION BY code) AS w FROM samples),
    w AS (SELECT id, round(w * (SELECT count(*) FROM w0) / (SELECT sum(w) FROM w0), 6) AS weight FROM w0)"""


def _mixed(k: str, seed: int) -> str:
    """SQL of datasets.mixed."""
    for shift, factor in ((15, 2654435761), (13, 1103515245), (16, 69069)):
        k = f"(SELECT xor(z, z >> {shift}) FROM (SELECT ({k} * {factor} + {seed}) % 2147483648 AS z) q{shift})"
    return k


@query(f"""WITH {WEIGHTS}, u AS (SELECT id, cast(round(weight * 1000000) AS bigint) AS u, {HASH} AS s FROM w), c AS (SELECT id, u, cast(sum(u) OVER (ORDER BY s, id) AS bigint) AS hi FROM u WHERE u > 0),
    t AS (SELECT max(hi) AS total FROM c), k AS (SELECT unnest(range((SELECT count(*) FROM samples))) AS draw),
    h AS (SELECT draw, {_mixed("draw", SEED)} AS high, {_mixed("(draw + 97)", SEED + 1)} AS low FROM k),
    p AS (SELECT draw, high * (total >> 31) + ((high * (total & 2147483647)) >> 31) + ((low * (total >> 31)) >> 31) AS place FROM h CROSS JOIN t)
    SELECT p.draw, c.id FROM p JOIN c ON p.place >= c.hi - c.u AND p.place < c.hi""")
def weighted_draws(s):
    """SMP-01: as many draws with replacement as there are samples."""
    samples = D.sampling_weights(s("samples"), 1.0, 0.5).select("id", F.round("weight", 6).alias("weight"))
    return D.draw_with_replacement(samples, s("samples").count(), SEED).select("draw", "id")


def _corrected(s: Source, key) -> DataFrame:
    """Corrected cells as rows of an archive ``job``; names hold the cell's own job."""
    name = F.concat(F.lit("g"), F.col("job").cast("string"), F.lit("_"), C.export_name(F.col("code"), F.col("row"), F.col("col"), F.lit(0), F.lit(9)))
    png = F.concat(F.lit("png "), name).cast("binary")
    return s("cells").filter("corrected_code IS NOT NULL").select(key.alias("job"), "row", "col", "code", name.alias("file"), F.lit(0).alias("hue"), F.lit(9).alias("brightness"), png.alias("png"))


@query("SELECT code AS label, 'g' || job || '_' || code || '_r' || (row + 1) || '_c' || (col + 1) || '_h0_v9.png' AS name, row + 1 AS row, col + 1 AS col, (4 + length('g' || job || '_' || code || '_r' || (row + 1) || '_c' || (col + 1) || '_h0_v9.png'))::bigint AS size FROM cells WHERE corrected_code IS NOT NULL")
def zip_cells_split(s):
    """SRC-11, JON-09: eight archive files, each read by many tasks through pieces of its directory, joined with their manifests."""
    path = folder(s.spark, "zips")
    sinks.write_archives(I.export_corrections(_corrected(s, F.col("job") % 8)), path)
    return readers.zip_cells(s.spark, path, 64 << 10).select("label", "name", "row", "col", "size")


TENSOR = ", ".join(EMB.format(i + 1) for i in range(48))
OF_CELL = [f"p[((row * 2 + {dy}) * 4 + col * 2 + {dx}) * 3 + {ch + 1}]" for dy in (0, 1) for dx in (0, 1) for ch in range(3)]


@query(f"""WITH i AS (SELECT vec_id AS job, [{TENSOR}] AS p FROM embeddings), c AS (SELECT job, p, r AS row, c AS col FROM i CROSS JOIN (SELECT unnest(range(2)) AS r) a CROSS JOIN (SELECT unnest(range(2)) AS c) b)
    SELECT job, row, col, 192::int AS n, round({OF_CELL[0]} / 255.0::double, 5) AS first, round({OF_CELL[-1]} / 255.0::double, 5) AS last, round(({' + '.join(OF_CELL)}) * 16 / 255.0::double, 2) AS total FROM c""")
def board_tensors(s):
    """OCR-01, OCR-20: boards of 4 x 4 pixels and 2 x 2 cells, each image decoded once, tensors of 8 x 8."""
    side = F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))
    cells = s.table("embeddings").select(F.col("vec_id").alias("job"), F.explode(side).alias("row")).select("job", "row", F.explode(side).alias("col"))
    cells = cells.select("job", "row", "col", (F.col("col") * 2).alias("x0"), (F.col("row") * 2).alias("y0"), (F.col("col") * 2 + 2).alias("x1"), (F.col("row") * 2 + 2).alias("y1"))
    images = stores._images(s).select(F.col("id").alias("job"), "content")
    t = I.board_tensors(images, cells, 8).withColumn("t", F.transform("tensor", lambda x: x.cast("double")))
    total = F.aggregate("t", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return t.select("job", "row", "col", F.size("t").alias("n"), F.round(F.element_at("t", 1), 5).alias("first"), F.round(F.element_at("t", -1), 5).alias("last"), F.round(total, 2).alias("total"))


def _artifacts(s: Source) -> DataFrame:
    """A model for each supplier: some without a name, a version or weights."""
    k = F.col("s_suppkey")
    about = F.to_json(F.struct(F.when(k % 3 != 0, F.concat(F.lit("bead-"), (k % 7).cast("string"))).alias("name"), F.when(k % 5 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("version"), F.when(k % 2 == 0, "cells").alias("input_name")))
    return s.table("supplier").select(F.concat(F.lit("m"), k.cast("string")).alias("id"), about.alias("manifest"), F.array(F.lit("<blank>"), F.lit("A"), F.lit("1")).alias("charset"), F.repeat(F.lit("w"), (k % 4).cast("int")).cast("binary").alias("model"))


@query("""SELECT 'm' || s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'bead-' || s_suppkey % 7 ELSE 'm' || s_suppkey END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'v' || s_suppkey END AS version,
    CASE WHEN s_suppkey % 2 = 0 THEN 'cells' ELSE 'images' END AS input_name, 'logits' AS output_name, s_suppkey % 4 AS length FROM supplier""")
def artifact_registry(s):
    """SNK-14, SRC-17, SRC-18: artefact folders published one by one, found again with their defaults; a second publication of a version fails."""
    path = folder(s.spark, "models")
    sinks.publish_artifacts(_artifacts(s), path)
    return readers.model_registry(s.spark, path)


@query("""SELECT 'm' || s_suppkey AS id, 'no version' AS problem FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'm' || s_suppkey, 'no weights' FROM supplier WHERE s_suppkey % 4 = 0""")
def artifact_problems(s):
    """OCR-16."""
    path = folder(s.spark, "models")
    sinks.publish_artifacts(_artifacts(s), path)
    return readers.checkpoint_problems(readers.model_registry(s.spark, path), ["<blank>", "A", "1"])


@query("""SELECT s_suppkey::int AS board, CASE s_suppkey % 6 WHEN 0 THEN 'no cells' WHEN 1 THEN 'size mismatch' WHEN 2 THEN 'missing image' WHEN 3 THEN 'image size mismatch' WHEN 4 THEN 'unreadable image' END AS reason,
    (CASE WHEN s_suppkey % 6 = 5 THEN (s_suppkey % 3 + 1) * 2 ELSE 0 END)::bigint AS cells FROM supplier""")
def board_folders(s):
    """SRC-16, SRC-22: a folder of boards with images, each skip reason kept as a row beside the boards that are used."""
    k = F.col("s_suppkey")
    rows, cols = (k % 3 + 1).cast("int"), F.lit(2)
    cell = lambda x: F.struct((F.floor(x / 2) + 1).cast("int").alias("row"), (x % 2 + 1).cast("int").alias("col"), F.lit("A1").alias("code"), F.lit("#000000").alias("color_hex"))
    n = F.when(k % 6 == 0, 0).when(k % 6 == 1, rows * cols - 1).otherwise(rows * cols)
    cells = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda x: x < n), cell)
    text = F.to_json(F.struct(F.lit(1).alias("format_version"), F.struct(F.lit("mard").alias("brand"), rows.alias("rows"), cols.alias("cols"), F.lit(4).alias("cell_size_px")).alias("board"), cells.alias("cells")))
    boards = s.table("supplier").select(k.cast("string").alias("name"), text.alias("text"), rows.alias("rows"), (k % 6).alias("kind"))
    path = folder(s.spark, "boards")
    sinks.write_boards_with_images(boards.select("name", "text", F.when(F.col("kind") == 2, -1).when(F.col("kind") == 4, 0).otherwise(F.col("rows") * 4 + F.when(F.col("kind") == 3, 1).otherwise(0)).alias("height"), F.lit(8).alias("width")), path)
    found = readers.board_folder(s.spark, path)
    used = readers.board_cells(found).groupBy("path").agg(F.count("*").alias("n"))
    return found.join(used, "path", "left").select(F.regexp_extract("path", r"([0-9]+)/board\.json$", 1).cast("int").alias("board"), "reason", F.coalesce("n", F.lit(0)).alias("cells"))


@query(f"""WITH u AS (SELECT id, code, {HASH} / 2147483648.0::double AS u, id % 256 AS r, id // 7 % 256 AS g, id * 31 % 256 AS b FROM samples),
    l AS (SELECT *, CASE WHEN u < 0.55 THEN 'clean' WHEN u < 0.55::double + 0.30::double THEN 'light' WHEN u < 0.55::double + 0.30::double + 0.13::double THEN 'medium' ELSE 'heavy' END AS level FROM u)
    SELECT id, code, level, 1200::int AS n, CASE WHEN level = 'clean' THEN round_even(r * 0.8::double, 0) + 2 * round_even(g * 0.8::double, 0) + 3 * round_even(b * 0.8::double, 0) END AS corner FROM l""")
def synthetic_cells(s):
    """PAL-18, PAL-20, PAL-11: a drawn cell of 20 x 20 pixels for each sample, decoded; the corner of those without noise."""
    k = F.col("id")
    hex_ = F.format_string("#%02X%02X%02X", k % 256, F.floor(k / 7) % 256, k * 31 % 256)
    path = folder(s.spark, "corpus")
    Y.cells(s("samples").select("id", "code", hex_.alias("hex")), SEED, 20).write.parquet(path)
    cells = s.spark.read.parquet(path)
    got = I.measured(cells.select("id", F.lit("orig").alias("variant"), "content"), "pixels").join(cells.select("id", "code", "level"), "id")
    v = lambda i: F.get("values", i)
    return got.select("id", "code", "level", F.size("values").alias("n"), F.when(F.col("level") == "clean", v(0) + 2 * v(1) + 3 * v(2)).alias("corner"))


@query(f"""WITH {ST}, p AS (SELECT code, {RGB} FROM dict), c AS (SELECT st.job, CASE WHEN st.status = 'MAPPED' THEN p.r + p.g + p.b WHEN st.code = 'BLANK' THEN 765 ELSE 612 END AS total, st.status FROM st LEFT JOIN p ON p.code = st.color_code)
    SELECT job, (28 * 32 * 3)::int AS n, ((56 - count(*)) * 765 + sum(total))::double * 16 AS total, count_if(status = 'MAPPED') AS recognised, count_if(status = 'UNMAPPED') AS missed FROM c GROUP BY 1""")
def board_redrawn(s):
    """SNK-13, OCR-19: every board drawn again from its recognised cells at four pixels a cell and read back; codes don't fit such tiles."""
    known = folder(s.spark, "dictionary")  # written first, so that its size is known when the join is planned and the cells stay where they are
    s("dict").write.parquet(known)
    cells = O.with_status(s("cells", by="job"), s.spark.read.parquet(known)).select(*O.KEY, "code", "status", "color_hex", F.lit(7).alias("rows"), F.lit(8).alias("cols"))
    path = folder(s.spark, "redrawn")
    Y.redraw(None, cells, 4).write.parquet(path)
    return I.totals(s.spark.read.parquet(path)).select("job", "n", "total", "recognised", "missed")


SAMPLE = "chr((65 + s_suppkey % 26)::int) || (s_suppkey % 1200)"
FILE = f"CASE WHEN s_suppkey % 4 < 2 THEN 'sample_' || s_suppkey || '_' || {SAMPLE} || '.png' WHEN s_suppkey % 4 = 2 THEN {SAMPLE} || '_r1_c' || s_suppkey || '.png' ELSE 'blank_' || s_suppkey || '.png' END"


def _sample_files(s: Source) -> DataFrame:
    """A file for each supplier, its name in one of three styles and the supplier's name as content."""
    k = F.col("s_suppkey")
    code = F.concat(F.char((65 + k % 26).cast("int")), (k % 1200).cast("string"))
    name = F.when(k % 4 < 2, F.concat(F.lit("sample_"), k.cast("string"), F.lit("_"), code, F.lit(".png"))).when(k % 4 == 2, F.concat(code, F.lit("_r1_c"), k.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("blank_"), k.cast("string"), F.lit(".png")))
    return s.table("supplier").select(k, name.alias("name"), F.col("s_name").cast("binary").alias("content"), code.alias("code"))


@query(f"SELECT name, label, cast(row_number() OVER (ORDER BY name) AS int) AS place FROM (SELECT {FILE} AS name, {SAMPLE} AS label, s_suppkey FROM supplier) x WHERE s_suppkey % 4 < 2 AND s_suppkey % 1200 < 1000")
def sample_folder(s):
    """SRC-12, SRC-13, SRT-13: the files of a folder whose name is sample_<n>_<letter and up to three digits>.png, in the order of their names."""
    path = folder(s.spark, "samples")
    sinks.write_files(_sample_files(s), path)
    found = readers.labelled_folder(s.spark, path, r"^sample_\d+_[A-Z]\d{1,3}\.png$")
    return O.with_rank(found.select("name", C.code_from_filename(F.col("name")).alias("label")), F.col("name"), "place").select("name", "label", F.col("place").cast("int").alias("place"))


@query(f"SELECT {FILE} AS name, sha256(s_name) AS digest FROM supplier")
def file_digests(s):
    """STR-12: the digest of each file of a folder."""
    path = folder(s.spark, "samples")
    sinks.write_files(_sample_files(s), path)
    return readers.labelled_folder(s.spark, path).select("name", F.sha2("content", 256).alias("digest"))


@query(f"""SELECT name, label FROM (SELECT {FILE} AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Q' || s_suppkey % 7 WHEN s_suppkey % 4 = 3 THEN 'BLANK' ELSE {SAMPLE} END AS label FROM supplier) x
    WHERE label = 'BLANK' OR regexp_full_match(label, '[A-Q0-9]*')""")
def labelled_samples(s):
    """SRC-14, SRC-15: a label of the manifest before one of the file name; labels out of the vocabulary fall away."""
    path, k = folder(s.spark, "samples"), F.col("s_suppkey")
    files = _sample_files(s)
    sinks.write_files(files, path)
    listed = files.filter(k % 3 == 0).select("name", F.concat(F.lit("q"), (k % 7).cast("string")).alias("code"))
    sinks.write_manifest(listed.select("code", F.col("name").alias("file"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("0").alias("hue"), F.lit(9).alias("brightness")), f"{path}-manifest")
    return readers.labels(readers.labelled_folder(s.spark, path), readers.manifest(s.spark, f"{path}-manifest"), [*"ABCDEFGHIJKLMNOPQ0123456789"]).select("name", "label")


@query("""SELECT replace(brand, '#', '') AS brand, code, name || ', "new"' AS name, hex, brand_rank FROM dict_raw WHERE ord % 5 <> 0 AND brand_rank <= 3""")
def brand_files(s):
    """SRC-09: a headerless file for each brand, names with commas and quotes, short rows; brands that aren't listed are left out."""
    d = s("dict_raw").withColumn("brand", F.replace("brand", F.lit("#"), F.lit("")))
    whole = F.format_string('%s,"%s, ""new""",1,2,3,%s,x', "code", "name", F.lower("hex"))
    lines = d.select("brand", F.when(F.col("ord") % 5 == 0, F.concat("code", F.lit(",short"))).otherwise(whole).alias("line"))
    path = folder(s.spark, "brands")  # a brand's part of a dictionary is one file
    sinks.write_files(lines.groupBy(F.concat("brand", F.lit(".csv")).alias("name")).agg(F.concat_ws("\n", F.collect_list("line")).cast("binary").alias("content")), path)
    listed = [r["brand"] for r in d.filter("brand_rank <= 3").select("brand").distinct().orderBy("brand").collect()]
    return readers.brand_csvs(s.spark, path, listed).select("brand", "code", "name", "hex", F.substring("brand", -1, 1).cast("int").alias("brand_rank"))


@query("SELECT code, name, substr(hex, 2) AS hex FROM dict")
def library_from_default(s):
    """SRC-07: no argument and no environment variable, so the default path."""
    path = folder(s.spark, "library")
    s("dict").select("code", "name", "hex", "brand").agg(F.to_json(F.collect_list(F.struct("code", "name", "hex", "brand"))).alias("value")).write.text(path)
    return readers.color_seed(s.spark, readers.library_path(None, "GRIDLOOM_NO_SUCH_LIBRARY", path)).select("code", "name", "hex")


@query("SELECT job, max(length(code))::int AS code_length, greatest(length((max(row) + 1)::varchar), length((max(col) + 1)::varchar))::int AS axis_length FROM cells WHERE code NOT IN ('BLANK', 'UNMAPPED', '') GROUP BY 1")
def font_sizes(s):
    """STR-19: what sizes a board's letters: its longest code and its longest axis label."""
    cells = s("cells").filter("code NOT IN ('BLANK', 'UNMAPPED', '')")
    label = lambda c: F.length((F.max(c) + 1).cast("string"))
    axis = cells.groupBy("job").agg(F.greatest(label("row"), label("col")).alias("axis_length"))
    return O.longest_code(cells).select("job", F.length("code").alias("code_length")).join(axis, "job")


@query("SELECT vec_id AS id, list_bool_and(list_transform(embedding, lambda x: abs(x::double - round(x::double, 4)) <= 1e-5::double + 1e-4::double * abs(round(x::double, 4)))) AS close FROM embeddings")
def export_within_tolerance(s):
    """OCR-25: outputs of two exports within a relative and an absolute tolerance."""
    v = F.col("embedding").cast("array<double>")
    pairs = s.table("embeddings").select(F.col("vec_id").alias("id"), v.alias("a"), F.transform(v, lambda x: F.round(x, 4)).alias("b"))
    return E.within(pairs, "a", "b").select("id", "close")
