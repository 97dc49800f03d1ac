"""Word documents: a reader that gives runs and blocks, and a writer that puts new texts back.

Files are read with Spark's binaryFile source and parsed in Arrow batches with the
standard library, so any store that Spark reads will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUN = "doc_id string, seq long, key string, kind string, style string, table_index int, row_index int, col_index int, cell_path string, paragraph_ix int, run_ix int, run_text string"
#: Core properties that are blanked on request.
PROPERTIES = ("creator", "lastModifiedBy", "title", "subject", "description", "category", "keywords", "identifier", "contentStatus")


def _runs(p: ET.Element) -> Iterator[ET.Element]:
    """Displayed runs, in hyperlinks and insertions too, not in deletions."""
    for x in p:
        if x.tag == f"{W}r":
            yield x
        elif x.tag not in (f"{W}del", f"{W}moveFrom", f"{W}pPr"):
            yield from _runs(x)


def _text(r: ET.Element) -> str:
    return "".join({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(x.tag, "") for x in r)


def _blocks(parent: ET.Element, path: str, tables: list[int]) -> Iterator[tuple]:
    """(kind, style, table, row, column, path, paragraphs) in document order; a nested table
    follows its cell."""
    for i, x in enumerate(parent):
        if x.tag == f"{W}p":
            style = x.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            yield ("heading" if name.lower().startswith(("heading", "title")) else "paragraph", name, None, None, None, f"{path}/{i}", [x])
        elif x.tag == f"{W}tbl":
            tables[0] += 1
            here = tables[0]
            for r, row in enumerate(x.findall(f"{W}tr")):
                c = 0
                for j, cell in enumerate(row.findall(f"{W}tc")):
                    span = cell.find(f"{W}tcPr/{W}gridSpan")
                    merge = cell.find(f"{W}tcPr/{W}vMerge")
                    if merge is not None and merge.get(f"{W}val", "continue") == "continue":
                        c += int(span.get(f"{W}val", "1")) if span is not None else 1
                        continue  # the text is in the cell above
                    at = f"{path}/{i}/{r}/{j}"
                    yield ("table-cell", "", here, r, c, at, cell.findall(f"{W}p"))
                    for k, inner in enumerate(cell.findall(f"{W}tbl")):
                        yield from _blocks(_Holder(inner), f"{at}/{k}", tables)
                    c += int(span.get(f"{W}val", "1")) if span is not None else 1


class _Holder(list):
    def __init__(self, x: ET.Element) -> None:
        super().__init__([x])


def parse(content: bytes) -> tuple[ET.Element, list[tuple]]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return root, list(_blocks(root.find(f"{W}body"), "", [-1]))


def rows_of(doc_id: str, content: bytes) -> list[tuple]:
    """One row for each run; paragraphs of a cell are joined by a line-feed run without number of its own."""
    out = []
    for seq, (kind, style, t, r, c, path, paragraphs) in enumerate(parse(content)[1]):
        ix = 0
        for n, p in enumerate(paragraphs):
            if n:
                out.append((doc_id, seq, f"{doc_id}#{seq}", kind, style, t, r, c, path, -1, ix, "\n"))
                ix += 1
            for run in _runs(p):
                out.append((doc_id, seq, f"{doc_id}#{seq}", kind, style, t, r, c, path, n, ix, _text(run)))
                ix += 1
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the documents under ``path``."""
    columns = [x.strip().split()[0] for x in RUN.split(",")]

    def part(frames):
        for f in frames:
            rows = [x for path, content in zip(f["path"], f["content"]) for x in rows_of(path, bytes(content))]
            yield pd.DataFrame(rows, columns=columns).astype({"table_index": "Int32", "row_index": "Int32", "col_index": "Int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(part, RUN)


def rewrite(content: bytes, new: dict[tuple[int, int], str], clear_metadata: bool = True) -> bytes:
    """The document with the texts of runs (seq, run_ix) replaced; formatting stays."""
    root, blocks = parse(content)
    for seq, block in enumerate(blocks):
        ix = 0
        for n, p in enumerate(block[-1]):
            ix += bool(n)
            for run in _runs(p):
                if (seq, ix) in new and new[seq, ix] != _text(run):
                    for x in [x for x in run if x.tag in (f"{W}t", f"{W}tab", f"{W}br")]:
                        run.remove(x)
                    t = ET.SubElement(run, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = new[seq, ix]
                ix += 1
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in old.infolist():
            data = old.read(item)
            if item.filename == "word/document.xml":
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            elif item.filename == "docProps/core.xml" and clear_metadata:
                core = ET.fromstring(data)
                for x in core:
                    if x.tag.rpartition("}")[2] in PROPERTIES:
                        x.text = ""
                data = ET.tostring(core, encoding="UTF-8", xml_declaration=True)
            z.writestr(item, data)
    return out.getvalue()


def properties(content: bytes) -> dict[str, str]:
    """The core properties that :func:`rewrite` blanks, as they are."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        core = ET.fromstring(z.read("docProps/core.xml"))
    found = {x.tag.rpartition("}")[2]: x.text or "" for x in core}
    return {k: v for k, v in found.items() if k in PROPERTIES and v}


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, properties`` of the documents under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def part(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["path"], "properties": [properties(bytes(c)) for c in f["content"]]})

    return files.mapInPandas(part, "doc_id string, properties map<string,string>")


def segments_of(runs: DataFrame) -> DataFrame:
    """Runs -> one segment for each paragraph and cell, with its section and headers."""
    from pyspark.sql import functions as F

    from spanveil.sources.segments import attach_headers, carry_sections

    block = ("doc_id", "seq", "key", "kind", "table_index", "row_index", "col_index")
    pieces = F.array_sort(F.collect_list(F.struct("run_ix", "run_text")))
    texts = runs.groupBy(*block).agg(F.array_join(F.transform(pieces, lambda r: r["run_text"]), "").alias("text"))
    placed = attach_headers(carry_sections(texts))
    cell = F.concat(F.lit("table "), (F.col("table_index") + 1).cast("string"), F.lit(" row "), (F.col("row_index") + 1).cast("string"), F.lit(" column "), (F.col("col_index") + 1).cast("string"))
    here = F.coalesce(cell, F.concat("kind", F.lit(" "), (F.col("seq") + 1).cast("string")))
    return placed.select("doc_id", "seq", "key", "text", F.concat_ws(" > ", "section", here).alias("location"), "kind", "section", "column_header")


def save_documents(contents: DataFrame, folder: str) -> DataFrame:
    """Writes ``doc_id, content`` under the names of the documents into a folder that all
    executors reach; gives the paths.  A task that is run again writes the same files again."""

    def part(frames):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for f in frames:
            paths = [f"{root}/{name.rsplit('/', 1)[-1]}" for name in f["doc_id"]]
            for path, content in zip(paths, f["content"]):
                with store.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"path": paths})

    return contents.select("doc_id", "content").mapInPandas(part, "path string")


def write_documents(spark: SparkSession, path: str, runs: DataFrame, clear_metadata: bool = True) -> DataFrame:
    """``doc_id, content``: the documents under ``path`` with the runs' ``new_text``; written
    to any store with a binary sink or from the frame."""
    from pyspark.sql import functions as F

    texts = runs.where("paragraph_ix >= 0").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "run_ix", "new_text")).alias("runs"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")

    def part(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "content": [rewrite(bytes(c), {(r["seq"], r["run_ix"]): r["new_text"] for r in (rs if rs is not None else [])}, clear_metadata) for c, rs in zip(f["content"], f["runs"])]})

    return files.join(texts, "doc_id", "left").mapInPandas(part, "doc_id string, content binary")
