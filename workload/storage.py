"""Queries that go through readers, sinks and the stream.

Each writes data derived from the shared tables to the shared checkpoint folder and reads
it back with the engine's own readers.
"""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.operators import audit, ledger
from inkledger.operators.manifest import detect_roles
from inkledger.plans import review
from inkledger.session import scratch_path
from inkledger.sources import images, manifests, sinks, versions
from inkledger.sources.heads import open_store
from inkledger.streaming import commits as stream
from workload import detection, imports
from workload import ledger as lw
from workload.registry import Tables, query
from workload.views import ctes


PARTS = 8


def _in_parts(rows: DataFrame) -> DataFrame:
    """A manifest in several part files whose names follow ``import_row``."""
    return rows.repartitionByRange(PARTS, "import_row").sortWithinPartitions("import_row")


def _written(rows: DataFrame, spark, **options) -> str:
    path = scratch_path(spark)
    _in_parts(rows).drop("import_row").write.options(**options).csv(path)
    return path


@query(
    "identifier_list_scan",
    "WITH " + ctes("manifest_v") + """ SELECT row_number() OVER (ORDER BY import_row) + 1 AS import_row, raw_identifier AS input_value FROM manifest_v WHERE import_row % 5 <> 0""",
)
def identifier_list_scan(t: Tables) -> DataFrame:
    lines = _in_parts(t.manifest_v.select("import_row", "raw_identifier")).select(
        F.when(F.col("import_row") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("raw_identifier"))).alias("value")
    )
    path = scratch_path(t.spark)
    lines.write.text(path)
    return manifests.read_identifier_list(t.spark, path, whole_folder=True).select("import_row", "input_value")


@query(
    "delimited_manifest_scan",
    "WITH " + ctes("manifest_v") + """ SELECT row_number() OVER (ORDER BY import_row) + 1 AS import_row, raw_identifier AS "UWI", raw_path AS "TIFPATH", raw_depth AS "Depth1", 'a "b"; c' AS column_4, raw_depth AS "depth1_2" FROM manifest_v""",
)
def delimited_manifest_scan(t: Tables) -> DataFrame:
    rows = t.manifest_v.select(
        F.col("raw_identifier").alias("UWI"), F.col("raw_path").alias("TIFPATH"), F.col("raw_depth").alias("Depth1"),
        F.lit('a "b"; c').alias(" "), F.concat(F.lit(" "), F.col("raw_depth")).alias("depth1"), "import_row",
    )
    renamed = rows.toDF("UWI", "TIFPATH", "Depth1", " ", "depth1 ", "import_row")
    path = _written(renamed, t.spark, header="true", sep=";", escape='"')
    return manifests.read_delimited(t.spark, path, whole_folder=True).drop("source_path")


@query(
    "quoted_manifest_parts",
    "WITH " + ctes("manifest_v") + """ SELECT row_number() OVER (ORDER BY import_row) + 1 AS import_row, raw_identifier AS "UWI",
         'top, ' || raw_depth || chr(10) || chr(10) || '"second" line' || CASE WHEN import_row % 7 = 0 THEN chr(10) || 'x,y' ELSE '' END AS "COMMENT", raw_path AS "TIFPATH"
       FROM manifest_v""",
)
def quoted_manifest_parts(t: Tables) -> DataFrame:
    """Comments with commas, quotes, blank lines and line breaks, in part files."""
    comment = F.concat(
        F.lit("top, "), F.col("raw_depth"), F.lit('\n\n"second" line'),
        F.when(F.col("import_row") % 7 == 0, F.lit("\nx,y")).otherwise(F.lit("")))
    rows = t.manifest_v.select(
        F.col("raw_identifier").alias("UWI"), comment.alias("COMMENT"), F.col("raw_path").alias("TIFPATH"), "import_row")
    path = _written(rows, t.spark, header="true", escape='"')
    return manifests.read_delimited(t.spark, path, whole_folder=True).drop("source_path")


@query(
    "manifest_file_to_status",
    imports.chain("SELECT load_status, count(*) AS n_rows FROM audit GROUP BY load_status"),
)
def manifest_file_to_status(t: Tables) -> DataFrame:
    rows = t.manifest_v.select(
        F.col("raw_identifier").alias("UWI"), F.col("raw_path").alias("TIFPATH"), F.col("raw_depth").alias("raw_depth"), "import_row",
    )
    path = _written(rows, t.spark, header="true", escape='"')
    table = manifests.read_delimited(t.spark, path, whole_folder=True)
    roles = detect_roles([c for c in table.columns if c not in ("import_row", "source_path")])
    plan = imports.ManifestImport(table, roles, t.catalog_v, t.probe_v, depth_filter=imports.DEPTH)
    return plan.audit.groupBy("load_status").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "audit_csv_sink",
    imports.chain("SELECT raw_identifier, CAST(import_row AS STRING) AS import_row, load_status, CASE WHEN well_loaded THEN 'True' ELSE 'False' END AS well_loaded FROM audit"),
)
def audit_csv_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark)
    sinks.write_audit(imports.plan(t).audit, path)
    back = t.spark.read.csv(path, header=True)
    return back.select("raw_identifier", "import_row", "load_status", "well_loaded")


@query(
    "review_table_save",
    lw.sql("""SELECT file_key, has_stamp, stamp_type, CASE WHEN p.k IS NULL THEN 1 ELSE 0 END AS save_phase, coalesce(p.pos, position) AS position
              FROM ledger_v LEFT JOIN (SELECT 'log_' || s_suppkey || '.tif' AS k, s_suppkey AS pos FROM supplier) p ON p.k = file_key"""),
)
def review_table_save(t: Tables) -> DataFrame:
    path = scratch_path(t.spark)
    order = t.supplier.select(F.concat(F.lit("LOG_"), F.col("s_suppkey"), F.lit(".tif")).alias("name"), F.col("s_suppkey").alias("position"))
    sinks.save_ledger(lw.ledger_of(t), path)
    sinks.save_ledger(sinks.load_ledger(t.spark, path), path, order)
    stored = t.spark.read.parquet(path)
    return stored.select(
        ledger.file_key("file_link").alias("file_key"), "has_stamp", F.col("type_of_stamp").alias("stamp_type"), "save_phase", "position"
    )


@query(
    "inventory_csv_sink",
    detection.sql("SELECT CAST(page_id AS STRING) AS page_id, CAST(det_id AS STRING) AS det_id, decision FROM pages_v LEFT JOIN decided_v USING (page_id)"),
)
def inventory_csv_sink(t: Tables) -> DataFrame:
    from inkledger.operators.detections import inventory

    path = scratch_path(t.spark)
    rows = detection.placed(t).select("det_id", "page_id", "score", "decision", "evidence", "attrs")
    sinks.write_inventory(inventory(detection.pages_of(t), rows, ["ring"], ["clipped"]).drop("score"), path)
    back = t.spark.read.csv(path, header=True)
    return back.select(F.col(back.columns[0]).alias("page_id"), "det_id", "decision")


@query(
    "label_catalog_round_trip",
    """SELECT r_name AS label, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS position FROM region""",
)
def label_catalog_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark)
    rows = t.region.select(F.col("r_regionkey").cast("long").alias("position"), F.col("r_name").alias("label"))
    again = rows.select((F.col("position") + 100).alias("position"), F.lower("label").alias("label"))
    sinks.save_labels(rows.unionByName(again), path)
    return sinks.load_labels(t.spark, path)


@query("commit_upsert_stream", lw.edits_sql(lw._EDIT_ROWS))
def commit_upsert_stream(t: Tables) -> DataFrame:
    source, target = scratch_path(t.spark), scratch_path(t.spark)
    drafts = lw.drafts_of(t)
    # Late commits, and the second third twice; a micro-batch takes two files.
    for part in (1, 2, 1, 0):
        drafts.filter(F.col("commit_id") % 3 == part).repartition(2).write.mode("append").parquet(source)
    incoming = t.spark.readStream.schema(drafts.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.start(incoming, target, scratch_path(t.spark), buckets=8).awaitTermination()
    return stream.current(t.spark, target).select(
        "file_key", "file_name", "has_stamp", "stamp_type", "commit_id", "reviewed_by"
    )


@query(
    "subset_from_import",
    imports.chain("SELECT identifier, id_rank AS position FROM wells WHERE n_resolved > 0"),
)
def subset_from_import(t: Tables) -> DataFrame:
    root = scratch_path(t.spark)
    assert review.replace_subset(imports.plan(t), lw.ledger_of(t), root)
    return versions.read_table(t.spark, root, "subset")


@query(
    "commit_and_progress",
    lw.edits_sql("SELECT count(CASE WHEN has_stamp IS NOT NULL THEN 1 END) AS n_reviewed, count(CASE WHEN has_stamp THEN 1 END) AS n_with_stamp, 0 AS n_incomplete FROM edits_v"),
)
def commit_and_progress(t: Tables) -> DataFrame:
    blank = lw.ledger_of(t).withColumns({
        "has_stamp": F.lit(None).cast("boolean"), "stamp_type": F.lit(""), "reviewed_at": F.lit(""), "reviewed_by": F.lit(""),
    })
    return review.commit_and_count(blank, lw.drafts_of(t))[1]


_BOOK_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_BOOK_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
BOOK_ROWS = 400


def _write_book(folder: str):
    """One workbook per group; every third has other headers in another order."""
    layouts = (("UWI", "TIFPATH"), ("TIFPATH", "Depth1", "UWI"), ("uwi", "Notes"))
    source = {"UWI": "raw_identifier", "uwi": "raw_identifier", "TIFPATH": "raw_path", "Depth1": "raw_depth", "Notes": "raw_depth"}

    def write(key, table):
        number, table = key[0].as_py(), table.sort_by("import_row")
        layout = layouts[number % 3]
        rows = [layout, *zip(*(table[source[h]].to_pylist() for h in layout))]
        cells = ["".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in row) for row in rows]
        sheet = "".join(f'<row r="{n}">{c}</row>' for n, c in enumerate(cells, 1))
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{number:06d}.xlsx") as out, zipfile.ZipFile(out, "w") as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{_BOOK_NS}" xmlns:r="{_BOOK_REL}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
            book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{_BOOK_NS}"><sheetData>{sheet}</sheetData></worksheet>')
        return table.select(["import_row"])

    return write


@query(
    "workbook_scan",
    "WITH " + ctes("manifest_v") + f""", b AS (SELECT *, import_row // {BOOK_ROWS} AS book FROM manifest_v)
       SELECT lpad(CAST(book AS VARCHAR), 6, '0') || '.xlsx' AS book, row_number() OVER (PARTITION BY book ORDER BY import_row) + 1 AS import_row,
              raw_identifier AS "UWI", CASE WHEN book % 3 < 2 THEN raw_path ELSE '' END AS "TIFPATH",
              CASE WHEN book % 3 = 1 THEN raw_depth ELSE '' END AS "Depth1", CASE WHEN book % 3 = 2 THEN raw_depth ELSE '' END AS "Notes" FROM b""",
)
def workbook_scan(t: Tables) -> DataFrame:
    """Many workbooks with three kinds of headers, united by name."""
    folder = scratch_path(t.spark)
    books = t.manifest_v.groupBy(F.expr(f"import_row div {BOOK_ROWS}").alias("book"))
    assert books.applyInArrow(_write_book(folder), "import_row long").count() > 0
    table = manifests.read_workbook(t.spark, folder)
    return table.withColumn("book", F.regexp_extract("source_path", "[^/]*$", 0)).drop("source_path")


def _write_files(folder: str):
    """One file per row, in four folders, for readers of real files."""

    def write(batches):
        store, root = open_store(folder)
        for batch in batches:
            for name, content in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                place = f"{root}/{len(content) % 4}"
                store.create_dir(place, recursive=True)
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(content)
            yield batch.select([0])

    return write


@query(
    "magic_byte_probe",
    """SELECT '/scans/' || page_id || '.tif' AS path, TRUE AS path_exists, page_id % 4 <> 3 AS readable,
              CASE WHEN page_id % 4 = 3 THEN 'not a readable image' ELSE '' END AS detail FROM pages""",
)
def magic_byte_probe(t: Tables) -> DataFrame:
    """Real files, one per page, of which the probe opens each and reads its head."""
    heads = {0: "49492A00", 1: "89504E470D0A1A0A", 2: "FFD8FFE0", 3: "00000000"}
    k = (F.col("page_id") % 4).cast("int")
    magic = F.element_at(F.create_map(*[F.lit(x) for kv in heads.items() for x in kv]), k)
    files = t.pages.select(
        F.concat("page_id", F.lit(".tif")).alias("name"),
        F.concat(F.unhex(magic), F.encode("html", "UTF-8")).alias("content"),
    )
    folder = scratch_path(t.spark)
    assert files.mapInArrow(_write_files(folder), "name string").count() == files.count()
    found = images.probe_images(t.spark, folder)
    return found.withColumn("path", F.concat(F.lit("/scans/"), F.regexp_extract("path", "[^/]*$", 0)))
