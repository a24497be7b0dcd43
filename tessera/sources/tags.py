"""Tag expressions (``name_<X,2>_<Y,2>.npy``), file patterns and the artefact catalog of a sample."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<(?P<name>[A-Za-z]\w*)?(?:,(?P<kind>[IS]))?(?:,(?P<width>\d+))?>")


@dataclass(frozen=True)
class Tag:
    name: str
    kind: str = "I"
    width: int | None = None

    def pattern(self) -> str:
        one = r"\d" if self.kind == "I" else "."
        return f"{one}{{{self.width}}}" if self.width else f"{one}+"

    def text(self, value) -> str:
        s = str(value)
        if self.width is None:
            return s
        return s.zfill(self.width) if self.kind == "I" else s.ljust(self.width)


class Expression:
    """A file name with tags."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tags: list[Tag] = []
        self.parts: list[str | Tag] = []
        at = 0
        for m in _TAG.finditer(text):
            self.parts.append(text[at : m.start()])
            tag = Tag(m["name"] or f"T{len(self.tags)}", m["kind"] or "I", int(m["width"]) if m["width"] else None)
            self.tags.append(tag)
            self.parts.append(tag)
            at = m.end()
        self.parts.append(text[at:])

    def names(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.tags))

    def glob(self, values: dict | None = None) -> str:
        values = values or {}
        return "".join(re.sub(r"([\[\]*?])", r"[\1]", p) if isinstance(p, str) else p.text(values[p.name]) if p.name in values else ("?" * p.width if p.width else "*") for p in self.parts)

    def re(self) -> str:
        seen: set[str] = set()
        out = ""
        for p in self.parts:
            if isinstance(p, str):
                out += re.escape(p)
            elif p.name in seen:
                out += f"(?P={p.name})"
            else:
                seen.add(p.name)
                out += f"(?P<{p.name}>{p.pattern()})"
        return out

    def string(self, values: dict) -> str:
        return "".join(p if isinstance(p, str) else p.text(values[p.name]) for p in self.parts)

    def string_from_index(self, index: list) -> str:
        return self.string(dict(zip(self.names(), index)))

    def values(self, string: str) -> dict:
        """Typed tag values; {} if the name does not fit."""
        m = re.fullmatch(self.re(), string)
        kinds = {t.name: t.kind for t in self.tags}
        return {k: int(v) if kinds[k] == "I" else v.rstrip() for k, v in m.groupdict().items()} if m else {}

    def indices(self, string: str) -> list:
        got = self.values(string)
        if not got:
            raise ValueError(f"{string} does not fit {self.text}")
        return [got[n] for n in self.names()]

    def columns(self, name: Column) -> list[Column]:
        """The tags of a name column as typed columns; null where the name does not fit."""
        pattern = "^" + "".join(re.escape(p) if isinstance(p, str) else f"({p.pattern()})" for p in self.parts) + "$"
        out, seen = [], set()
        for i, t in enumerate(self.tags):
            if t.name not in seen:
                seen.add(t.name)
                v = F.nullif(F.regexp_extract(name, pattern, i + 1), F.lit(""))
                out.append((v.cast("int") if t.kind == "I" else F.rtrim(v)).alias(t.name))
        return out

    def format(self) -> Column:
        """The name made from columns called like the tags."""
        parts = []
        for p in self.parts:
            if isinstance(p, str):
                parts.append(F.lit(p))
            else:
                v = F.col(p.name).cast("string")
                parts.append(v if p.width is None else F.lpad(v, p.width, "0") if p.kind == "I" else F.rpad(v, p.width, " "))
        return F.concat(*parts)


def detect(strings: list[str], names: list[str] | None = None) -> Expression:
    """Tags where names of equal length differ: each run of differing (or adjacent digit) characters is a tag."""
    if len({len(s) for s in strings}) > 1:
        raise ValueError("names of different lengths")
    first = strings[0]
    vary = [len({s[i] for s in strings}) > 1 for i in range(len(first))]
    for i in range(1, len(first)):
        if vary[i - 1] and all(s[i].isdigit() and s[i - 1].isdigit() for s in strings):
            vary[i] = True
    for i in range(len(first) - 2, -1, -1):
        if vary[i + 1] and all(s[i].isdigit() and s[i + 1].isdigit() for s in strings):
            vary[i] = True
    out, i, k = "", 0, 0
    while i < len(first):
        if not vary[i]:
            out += first[i]
            i += 1
            continue
        j = i
        while j < len(first) and vary[j]:
            j += 1
        kind = "I" if all(s[i:j].isdigit() for s in strings) else "S"
        name = names[k] if names and k < len(names) else f"T{k}"
        out += f"<{name},{kind},{j - i}>"
        k += 1
        i = j
    return Expression(out)


def file_list(spark: SparkSession, folder: str, expression: str) -> DataFrame:
    """path and tag columns of the files under ``folder`` whose name fits, by name."""
    e = Expression(expression)
    files = spark.read.format("binaryFile").option("pathGlobFilter", e.glob()).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", *e.columns(name)).filter(" and ".join(f"`{n}` is not null" for n in e.names()) or "true").orderBy("path")


def list_shape(files: DataFrame, names: list[str]) -> DataFrame:
    """Extent (largest - smallest + 1) of each tag: one row."""
    return files.agg(*[(F.max(n) - F.min(n) + 1).alias(n) for n in names])


def columns_of_tiles(files: DataFrame, by: list[str], order: str) -> DataFrame:
    """The files of each (x, y) column in the order of z."""
    return files.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "path"))), lambda s: s["path"]).alias("paths"))


#: File names of a sample's artefacts; those of all samples, and what samples of vessels and of cells have besides or instead.
ARTEFACTS = {
    "raw": "Raw/raw_<X,2>_<Y,2>.npy",
    "autofluorescence": "Autofluorescence/auto_<X,2>_<Y,2>.npy",
    "stitched": "stitched.npy",
    "layout": "layout.lyt",
    "background": "background.npy",
    "resampled": "resampled.tif",
    "resampled_to_auto": "elastix_resampled_to_auto",
    "auto_to_reference": "elastix_auto_to_reference",
}
TUBE_MAP_ARTEFACTS = {
    "arteries": "Raw/arteries_<X,2>_Y,2>.npy",
    "binary": "binary.npy",
    "binary_status": "binary_status.npy",
    "skeleton": "skeleton.npy",
    "graph": "graph.gt",
    "density": "density.tif",
}
CELL_MAP_ARTEFACTS = {
    "raw": "Raw/Z<Z,4>.tif",
    "autofluorescence": "Autofluorescence/Z<Z,4>.tif",
    "cells": "cells.npy",
    "density": "density.tif",
}


class Workspace:
    """Names of a sample's artefacts below its folder."""

    def __init__(self, directory: str, prefix: str | None = None, artefacts: dict[str, str] | None = None) -> None:
        self.directory, self.prefix = directory.rstrip("/"), prefix
        self.artefacts = dict(artefacts or {**ARTEFACTS, **TUBE_MAP_ARTEFACTS, "cells": CELL_MAP_ARTEFACTS["cells"]})
        self.debug: str | None = None

    def filename(self, kind: str, values: dict | None = None, postfix: str | list[str] | None = None, extension: str | None = None) -> str:
        if kind not in self.artefacts:
            raise KeyError(f"no artefact {kind}")
        stem, dot, end = self.artefacts[kind].partition(".")
        head, slash, name = stem.rpartition("/")
        bits = [self.prefix, name, *([postfix] if isinstance(postfix, str) else postfix or []), self.debug]
        full = f"{head}{slash}{'_'.join(b for b in bits if b)}"
        end = extension.lstrip(".") if extension else end
        out = f"{self.directory}/{full.lstrip('/')}{dot or ('.' if end else '')}{end}"
        return Expression(out).string(values) if values else out

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        """The artefact as a written table."""
        return spark.read.parquet(f"{self.directory}/{kind}.parquet")


def ome_value(xml: Column, path: str, kind: str = "double") -> Column:
    """A value of OME-XML text by XPath."""
    return {"double": F.xpath_double, "int": F.xpath_int, "string": F.xpath_string}[kind](xml, F.lit(path))


def fill_auto(value: Column, found: Column) -> Column:
    """'auto' (or null) replaced by the metadata's value."""
    return F.when(value.isNull() | (value == "auto"), found.cast("string")).otherwise(value)


def parameter_entries(text: DataFrame) -> DataFrame:
    """key, values of '(Key value ...)' lines of a parameter file (column value)."""
    line = F.regexp_extract("value", r"^\s*\((.*)\)\s*$", 1)
    rows = text.withColumn("_l", line).filter("_l <> ''")
    parts = F.split("_l", r"\s+")
    return rows.select(parts[0].alias("key"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_replace(p, '"', "")).alias("values"))
