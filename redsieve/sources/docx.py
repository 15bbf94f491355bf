"""Word documents: a source that gives one row for each text block, and a sink that rewrites them.

Files come and go as binary columns, so any store that Spark reads will do. Only the
standard library is used. A file is taken apart into places, a row for each paragraph wherever it
shows: a paragraph of a merged cell shows in every column and row that the cell covers. What a block is
told by its surroundings follows from places by grouping: the text of cells, rows
and heads of tables, and which places are one paragraph. A paragraph's text is that of all its text nodes,
those in hyperlinks included. A file that can't be read gives one row that says why.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RUNS = "array<struct<run_idx:int,start:int,end:int,text:string>>"
#: A row for each place where a paragraph (the par-th of its part) shows, numbered by seq; tbl numbers a document's tables, row and col count from 0.
PLACES = f"doc_id string, seq int, part string, par int, location string, tbl int, row int, col int, text string, runs {RUNS}, error string"
BLOCKS = ("doc_id", "block_idx", "part", "par", "text", "context", "location", "is_header", "runs", "error")
PROPERTIES = ("creator", "lastModifiedBy", "category", "description", "keywords", "subject", "title")
APP_PROPERTIES = ("Company", "Manager")
#: Names under which what was scrubbed is reported.
REPORTED = {"creator": "author", "lastModifiedBy": "last_modified_by", "description": "comments", "Company": "company", "Manager": "manager"}
#: What reading a damaged file may raise.
UNREADABLE = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, EOFError, zlib.error)
_KINDS = (("default", ""), ("first", "first_page_"), ("even", "even_page_"))


def _texts(par: ET.Element) -> list[ET.Element]:
    """The text-bearing nodes of a paragraph, without those of text boxes in it."""
    out = []

    def walk(node: ET.Element) -> None:
        for child in node:
            if child.tag in (W + "t", W + "tab", W + "br", W + "cr"):
                out.append(child)
            elif child.tag not in (W + "p", W + "tbl", W + "txbxContent", W + "pict", W + "drawing", W + "del"):
                walk(child)

    walk(par)
    return out


def _plain(node: ET.Element) -> str:
    return node.text or "" if node.tag == W + "t" else "\t" if node.tag == W + "tab" else "\n"


def _runs(par: ET.Element) -> list[dict]:
    ends = list(itertools.accumulate(len(_plain(n)) for n in _texts(par)))
    return [{"run_idx": k, "start": end - len(_plain(n)), "end": end, "text": _plain(n)} for k, (n, end) in enumerate(zip(_texts(par), ends, strict=True))]


def _setting(cell: ET.Element, name: str) -> ET.Element | None:
    return cell.find(f"{W}tcPr/{W}{name}")


def _grid(table: ET.Element) -> list[list[ET.Element]]:
    """For each row the cell that covers each column. A cell that goes on from above is the one above."""
    grid: list[list[ET.Element]] = []
    for row in table.iterfind(f"{W}tr"):
        line: list[ET.Element] = []
        for cell in (c for holder in (row, *row.iterfind(f"{W}sdt/{W}sdtContent")) for c in holder.iterfind(f"{W}tc")):
            wide, merged = _setting(cell, "gridSpan"), _setting(cell, "vMerge")
            goes_on = merged is not None and merged.get(W + "val", "continue") == "continue" and grid and len(grid[-1]) > len(line)
            line += [grid[-1][len(line)] if goes_on else cell] * (1 if wide is None else int(wide.get(W + "val", "1")))
        grid.append(line)
    return grid


def _shown(root: ET.Element, location: str, table_location: str, pars_first: bool, tables: Iterator[int]) -> Iterator[tuple]:
    """(paragraph, location, table, row, column) of all places of a part, in order."""
    stack = [(root, location, None)]
    while stack:
        holder, where, at = stack.pop()
        if holder.tag == W + "p":
            yield holder, where, *(at or (None, None, None))
        elif holder.tag == W + "tbl":
            number = next(tables)
            cells = [(cell, table_location, (number, r, c)) for r, line in enumerate(_grid(holder)) for c, cell in enumerate(line)]
            stack += reversed(cells)
        else:
            inside = [c for c in holder if c.tag in (W + "p", W + "tbl")]
            if pars_first and at is None:
                inside.sort(key=lambda c: c.tag == W + "tbl")
            stack += [(c, where, at) for c in reversed(inside)]


def _parts(archive: zipfile.ZipFile, tree: ET.Element) -> Iterator[tuple[str, str]]:
    """(part name, location) of headers and footers, section by section; a section without its own shows that of the one before."""
    try:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("word/_rels/document.xml.rels"))}
    except KeyError:
        return
    for i, section in enumerate(tree.iter(W + "sectPr")):
        for kind, prefix in _KINDS:
            for tag in ("header", "footer"):
                for ref in section.findall(f"{W}{tag}Reference"):
                    if ref.get(W + "type", "default") == kind and (target := rels.get(ref.get(R + "id"))):
                        yield "word/" + target.lstrip("/").removeprefix("word/"), f"section{i}:{prefix}{tag}"


def places(content: bytes) -> Iterator[dict]:
    """PLACES of one document, but for doc_id, seq and error."""
    tables = itertools.count()
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        tree = ET.fromstring(archive.read("word/document.xml"))
        parts = [("word/document.xml", tree.find(W + "body"), "body", "body:table", False)]
        named = dict.fromkeys(part for part, _ in _parts(archive, tree) if part in archive.namelist())
        first = {}
        for part, location in _parts(archive, tree):
            first.setdefault(part, location)
        parts += [(part, ET.fromstring(archive.read(part)), first[part], first[part], True) for part in named]
        for part, root, location, table_location, pars_first in parts:
            whole = tree if part == "word/document.xml" else root
            number = {par: i for i, par in enumerate(whole.iter(W + "p"))}
            for par, where, tbl, row, col in _shown(root, location, table_location, pars_first, tables):
                runs = _runs(par)
                yield {"part": part, "par": number[par], "location": where, "tbl": tbl, "row": row, "col": col, "text": "".join(r["text"] for r in runs), "runs": runs}


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all .docx files under a path of any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def places_of(files: DataFrame) -> DataFrame:
    """PLACES of documents (path, content); doc_id is the path."""
    columns = [c.split()[0] for c in PLACES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"doc_id": doc, "seq": i, **p} for i, p in enumerate(places(bytes(content)))]
                except UNREADABLE as error:
                    rows = [{"doc_id": doc, "error": f"{type(error).__name__}: {error}"}]
                if rows:
                    yield pd.DataFrame([dict.fromkeys(columns) | r for r in rows], columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(run, PLACES)


def _in_order(by: str, what: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), sep)


def blocks_of(files: DataFrame) -> DataFrame:
    """BLOCKS of documents (path, content): a row for each paragraph that isn't blank, in order of its first place.

    A block in a table has the table's first row and its own as context; one that shows in several rows has all of these contexts,
    but for such as another has in it, and is a header if one of its places is in a first row. A document that can't be read has one row with its error.
    """
    # everything below goes by document, so this is the only shuffle
    shown = places_of(files).repartition("doc_id")
    inside = shown.where("tbl is not null")
    cells = inside.groupBy("doc_id", "tbl", "row", "col").agg(_in_order("seq", "text", "\n").alias("cell"))
    rows = cells.groupBy("doc_id", "tbl", "row").agg(_in_order("col", "cell", " | ").alias("line"))
    heads = rows.where("row = 0").select("doc_id", "tbl", F.col("line").alias("head"))
    contexts = rows.join(heads, ["doc_id", "tbl"]).select("doc_id", "tbl", "row", F.concat_ws(" | ", "head", "line").alias("context"))
    told = shown.where("error is null").withColumns({"tbl": F.coalesce("tbl", F.lit(-1)), "row": F.coalesce("row", F.lit(-1))}).join(contexts, ["doc_id", "tbl", "row"], "left")
    pars = told.where(F.col("text").rlike(r"(?U)\S")).groupBy("doc_id", "part", "par").agg(
        F.min("seq").alias("seq"),
        *(F.min_by(c, "seq").alias(c) for c in ("text", "location", "runs")),
        F.max(F.col("row") == 0).alias("is_header"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "context"))), lambda x: F.coalesce(x["context"], F.lit(""))).alias("contexts"),
    )
    both = lambda acc, c: F.when(acc == "", c).when(F.contains(acc, c), acc).otherwise(F.concat_ws(" | ", acc, c))
    order = Window.partitionBy("doc_id").orderBy("seq")
    blocks = pars.withColumns({"context": F.aggregate("contexts", F.lit(""), both), "block_idx": F.row_number().over(order) - 1, "error": F.lit(None).cast("string")})
    return blocks.select(*BLOCKS).unionByName(shown.where("error is not null").select("doc_id", "error"), allowMissingColumns=True)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return blocks_of(files_under(spark, path))


def splice_runs(runs: list[tuple[int, int, str]], replacements: list[tuple[int, int, str]]) -> list[str]:
    """New texts of runs (start, end, text), which follow each other. What is put in stands in the run where it starts; what it takes the place of goes from all runs."""
    edits = sorted(replacements)
    out = []
    for a, b, text in runs:
        # what is left of a run are the gaps between the edits that reach into it
        pieces, at = [], a
        for start, end, new in edits:
            if start < b and end > a:
                pieces += [text[at - a : max(start - a, 0)], new if start >= a else ""]
                at = min(end, b)
        out.append("".join([*pieces, text[at - a :]]))
    return out


def scrub(xml: bytes, names: tuple[str, ...]) -> tuple[bytes, list[str]]:
    """Properties with text set to Redacted, and which."""
    root, changed = ET.fromstring(xml), []
    for node in root:
        name = re.sub(r"^\{.*\}", "", node.tag)
        if name in names and node.text:
            node.text = "Redacted"
            changed.append(REPORTED.get(name, name))
    return ET.tostring(root, "UTF-8", xml_declaration=True), changed


def rewrite(content: bytes, edits: list[tuple[str, int, int, int, str]], scrub_metadata: bool = True) -> tuple[bytes, list[str]]:
    """A document with edits (part, paragraph, start, end, new text) made, formatting kept; and the properties scrubbed."""
    by_part: dict[str, dict[int, list]] = {}
    for part, par, start, end, new in edits:
        by_part.setdefault(part, {}).setdefault(par, []).append((start, end, new))
    out, scrubbed = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename in by_part:
                root = ET.fromstring(data)
                pars = list(root.iter(W + "p"))
                for par, replacements in by_part[info.filename].items():
                    runs = [(r["start"], r["end"], r["text"]) for r in _runs(pars[par])]
                    for node, text in zip(_texts(pars[par]), splice_runs(runs, replacements), strict=True):
                        if text != _plain(node):
                            node.tag, node.text = W + "t", text
                            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                data = ET.tostring(root, "UTF-8", xml_declaration=True)
            elif scrub_metadata and info.filename in ("docProps/core.xml", "docProps/app.xml"):
                data, changed = scrub(data, PROPERTIES if info.filename.endswith("core.xml") else APP_PROPERTIES)
                scrubbed += changed
            new.writestr(info, data)
    return out.getvalue(), scrubbed


def redact_files(files: DataFrame, config=None, scope: str = "doc_id") -> DataFrame:
    """doc_id, content (binary, the redacted document), scrubbed, n_entities, error for each of the documents (path, content).

    A document that can't be read has no content, and its error.

    Names are shared within the scope, a column of BLOCKS; by default that is the document. A document is rewritten in one task, as its file is one value.
    """
    from ..operators.redact import detect, with_surrogates
    from ..plans.config import RedactionConfig

    config = config or RedactionConfig()
    found = detect(blocks_of(files), scope=scope, config=config).where("size(spans) > 0")
    edits = found.select("doc_id", "part", "par", F.inline(with_surrogates(F.col("spans"), config.salt))).groupBy("doc_id").agg(
        F.collect_list(F.struct("part", "par", "start", "end", "new")).alias("edits")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content, made in batch.itertuples(index=False, name=None):
                made = [tuple(e[k] for k in ("part", "par", "start", "end", "new")) for e in (made if made is not None else [])]
                row = {"doc_id": doc, "content": None, "scrubbed": [], "n_entities": 0, "error": None}
                try:
                    row["content"], row["scrubbed"] = rewrite(bytes(content), made, config.scrub_metadata)
                    row["n_entities"] = len(made)
                except UNREADABLE as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                yield pd.DataFrame([row])

    both = files.select(F.col("path").alias("doc_id"), "content").join(edits, "doc_id", "left").select("doc_id", "content", "edits")
    return both.mapInPandas(run, "doc_id string, content binary, scrubbed array<string>, n_entities long, error string")


def redact_docx(spark: SparkSession, path: str, config=None) -> DataFrame:
    """redact_files() of all .docx files under a path."""
    return redact_files(files_under(spark, path), config)


#: A table's cell that goes on from above.
ABOVE = "\x00above"


def document(paragraphs: list[str], tables: list[list[list[str]]] = (), header: str = "", author: str = "") -> bytes:
    """A small .docx with these paragraphs, tables and page header. In a table, a cell that is None belongs to the one before it, and one that is ABOVE to the one above."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    par = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{esc(t)}</w:t></w:r></w:p>'

    def row(cells: list[str | None]) -> str:
        out = []
        for i, cell in enumerate(cells):
            if cell is None:
                continue
            span = 1
            while i + span < len(cells) and cells[i + span] is None:
                span += 1
            merged = '<w:vMerge/>' if cell == ABOVE else '<w:vMerge w:val="restart"/>'
            out.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{merged}</w:tcPr>{par("" if cell == ABOVE else cell)}</w:tc>')
        return f"<w:tr>{''.join(out)}</w:tr>"

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    ref = '<w:headerReference w:type="default" r:id="rId1"/>' if header else ""
    body = "".join(map(par, paragraphs)) + "".join(f"<w:tbl>{''.join(map(row, t))}</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}<w:sectPr>{ref}</w:sectPr></w:body></w:document>")
        if header:
            archive.writestr("word/header1.xml", f"<w:hdr {ns}>{par(header)}</w:hdr>")
            archive.writestr(
                "word/_rels/document.xml.rels",
                '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="header" Target="header1.xml"/></Relationships>',
            )
        core = f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{esc(author)}</dc:creator></cp:coreProperties>'
        archive.writestr("docProps/core.xml", core)
    return out.getvalue()
