"""Output of results: files by Spark's writers, and short reports as text on the driver."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "table", "csv", "yaml", "paths", "tree")
#: Rows that a report on the driver may have.
REPORT_ROWS = 100_000


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def flat(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """The named columns (all by default) with nested values as JSON; names that don't exist are null."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(F.lit(None).cast("string").alias(c) if c not in kinds else F.to_json(c).alias(c) if _nested(kinds[c]) else F.col(c) for c in headers or df.columns))


def write_csv(df: DataFrame, path: str, headers: list[str] | None = None) -> None:
    flat(df, headers).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_paths(df: DataFrame, path: str, key: str = "filepath") -> None:
    df.filter(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def json_column(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def _rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(REPORT_ROWS + 1).toLocalIterator()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows for a report; write files instead")
    return rows


def to_json(df: DataFrame) -> str:
    return json.dumps(_rows(df), ensure_ascii=False, indent=2, default=str)


def to_csv(df: DataFrame, headers: list[str] | None = None) -> str:
    rows = _rows(df)
    if not rows:
        return ""
    out = io.StringIO()
    sheet = csv.DictWriter(out, fieldnames=headers or df.columns, extrasaction="ignore")
    sheet.writeheader()
    sheet.writerows({k: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, list | dict) else v for k, v in r.items()} for r in rows)
    return out.getvalue()


def to_yaml(df: DataFrame) -> str:
    import yaml

    return yaml.safe_dump(json.loads(to_json(df)), allow_unicode=True, sort_keys=False, indent=2)


def to_paths(df: DataFrame, key: str = "filepath") -> str:
    return "\n".join(str(r[key]) for r in _rows(df.select(key)) if r[key])


def to_table(df: DataFrame, columns: list[str] | None = None, title: str | None = None) -> str:
    """Columns padded to their widest value; nested values are cut to 50 characters of JSON."""
    rows = _rows(df)
    if not rows:
        return "(No data)"
    names = columns or df.columns
    cell = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False, default=str)[:50] if isinstance(v, list | dict) else str(v)
    lines = [list(names)] + [[cell(r.get(c, "")) for c in names] for r in rows]
    wide = [max(len(line[i]) for line in lines) for i in range(len(names))]
    drawn = [" | ".join(v.ljust(w) for v, w in zip(line, wide, strict=True)).rstrip() for line in lines]
    return "\n".join(([title] if title else []) + [drawn[0], "-+-".join("-" * w for w in wide)] + drawn[1:])


def to_tree(df: DataFrame, root: str = "notes", group_by: str = "type") -> str:
    """Titles with ids under their groups; groups sorted, items in the order of the input."""
    groups: dict[str, list[dict]] = {}
    for r in _rows(df):
        groups.setdefault(str(r.get(group_by, "unknown")), []).append(r)
    out = [f"{root}/"]
    for name in sorted(groups):
        out.append(f"  {name}/")
        out += [f"    {r.get('title', 'Untitled')}" + (f" ({r['id']})" if r.get("id") else "") for r in groups[name]]
    return "\n".join(out)


def render(df: DataFrame, kind: str, **options) -> str:
    kinds = {"json": to_json, "table": to_table, "csv": to_csv, "yaml": to_yaml, "paths": to_paths, "tree": to_tree}
    if kind.lower() not in kinds:
        raise ValueError(f"unsupported format {kind}; one of {', '.join(FORMATS)}")
    return kinds[kind.lower()](df, **options)


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hits with the columns of their flat form."""
    return hits.select("id", "title", "type", "score", "search_mode")


def markdown(notes: DataFrame) -> DataFrame:
    """(filepath, text): notes as files with front matter; an empty source is left out."""
    from marginalia.session import ship

    ship(notes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"filepath": [file_of(r) for r in b.to_dict("records")], "text": [to_markdown(r) for r in b.to_dict("records")]})

    own = notes.select("id", "title", "content", "type", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated"), "tags", "links", "backlinks", "source")
    return own.mapInPandas(run, "filepath string, text string")


def file_of(note: dict) -> str:
    import re

    if note["type"] == "fleeting":
        return f"fleeting/{note['id'][:8]}-{note['id'][8:]}.md"
    return f"{note['type']}/{note['id']}-{re.sub(r'[^\w\-]', '', note['title'].lower().replace(' ', '-')[:50])}.md"


def to_markdown(note: dict) -> str:
    import yaml

    lists = {c: [] if note.get(c) is None else [str(x) for x in note[c]] for c in ("tags", "links", "backlinks")}
    front = {c: note[c] for c in ("id", "title", "type", "created", "updated")} | lists | ({"source": note["source"]} if note.get("source") else {})
    return f"---\n{yaml.dump(front, allow_unicode=True, sort_keys=False)}---\n\n# {note['title']}\n\n{note['content']}\n"


def export_markdown(notes: DataFrame, folder: str) -> DataFrame:
    """Write each note to its file below a folder that all executors share, by a new name and a rename; (filepath) of what was written."""
    files = markdown(notes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for name, text in zip(b["filepath"], b["text"], strict=True):
                path = f"{top}/{name}"
                store.create_dir(os.path.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(text.encode("utf-8"))
                store.move(part, path)
                done.append(path)
            yield pd.DataFrame({"filepath": done})

    return files.mapInPandas(run, "filepath string")
