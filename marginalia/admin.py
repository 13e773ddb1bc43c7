"""Knowledge bases and templates: small registries and their tables. ``marginalia.settings`` keeps them in files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that no base may have.
RESERVED = ("notes", ".zk", ".zk_config.json")


@dataclass
class Registry:
    """Knowledge bases by name, all under one root folder, and the default one."""

    root: str
    default: str | None = None
    bases: dict[str, dict] = field(default_factory=dict)

    def create(self, name: str, path: str | None = None, description: str | None = None, make_default: bool = False) -> None:
        path = (path or f"{self.root}/{name}").rstrip("/")
        if name in self.bases:
            raise ValueError(f"knowledge base {name} exists")
        if name.lower() in RESERVED:
            raise ValueError(f"{name} is reserved")
        if not f"{path}/".startswith(f"{self.root.rstrip('/')}/") or ".." in path.split("/"):
            raise ValueError(f"{path} is outside {self.root}")
        if any(b["path"] == path for b in self.bases.values()):
            raise ValueError(f"{path} is in use")
        now = datetime.now().isoformat()
        self.bases[name] = {"name": name, "path": path, "created": now, "description": description, "last_used": now}
        if make_default or self.default is None:
            self.default = name

    def remove(self, name: str) -> dict:
        if name not in self.bases:
            raise KeyError(name)
        if len(self.bases) == 1:
            raise ValueError("the last knowledge base can't be removed")
        gone = self.bases.pop(name)
        if self.default == name:
            self.default = next(iter(self.bases))
        return gone

    def rename(self, old: str, new: str) -> None:
        if old not in self.bases or new in self.bases or new.lower() in RESERVED:
            raise ValueError(f"can't rename {old} to {new}")
        self.bases[new] = self.bases.pop(old) | {"name": new}
        if self.default == old:
            self.default = new

    def use(self, name: str) -> None:
        if name not in self.bases:
            raise KeyError(name)
        self.default = name
        self.bases[name]["last_used"] = datetime.now().isoformat()

    def current(self, name: str | None = None) -> dict:
        """The named base, else the default one."""
        return self.bases[name or self.default]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Registry:
        return cls(**json.loads(text))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(*(b[c] for c in ("name", "path", "created", "description", "last_used")), b["name"] == self.default) for b in self.bases.values()]
        return spark.createDataFrame(rows, "name string, path string, created string, description string, last_used string, is_current boolean")


def base_stats(registry: DataFrame, notes: DataFrame) -> DataFrame:
    """Bases with total and by_type counts of the notes in their partition ``kb``."""
    each = notes.groupBy("kb", "type").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy(F.col("kb").alias("name")).agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    return registry.join(per, "name", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


# The built-in templates.
BUILTIN = {
    "quick": {"description": "快速记录想法", "note_type": "fleeting", "title_format": "{{date}}-{{title}}", "content": "## 快速笔记\n\n创建于 {{datetime}}\n\n{{content}}", "tags": ["fleeting"]},
    "meeting": {
        "description": "会议记录模板",
        "note_type": "permanent",
        "title_format": "{{date}}-{{title}}",
        "content": "## 会议信息\n- **日期**: {{date}}\n- **时间**: {{time}}\n\n## 参会人员\n\n## 议程\n\n## 会议内容\n\n{{content}}\n\n## 行动项\n- [ ] ",
        "tags": ["meeting", "permanent"],
    },
    "literature": {
        "description": "阅读笔记模板",
        "note_type": "literature",
        "title_format": "{{title}}",
        "content": "## 文献信息\n- **来源**: {{source}}\n- **作者**: \n- **阅读日期**: {{date}}\n\n## 核心观点\n\n## 个人思考\n\n## 关联笔记\n\n{{content}}",
        "tags": ["literature"],
    },
}


class Templates:
    def __init__(self, own: dict[str, dict] | None = None):
        self.all = {**BUILTIN, **(own or {})}

    def create(self, name: str, template: dict, force: bool = False) -> None:
        if name in self.all and not force:
            raise ValueError(f"template {name} exists")
        self.all[name] = template

    def remove(self, name: str) -> None:
        if name in BUILTIN:
            raise ValueError(f"{name} is built in")
        del self.all[name]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, t["description"], t["note_type"], t["title_format"], t["content"], t["tags"], n in BUILTIN) for n, t in sorted(self.all.items())]
        return spark.createDataFrame(rows, "name string, description string, note_type string, title_format string, content string, tags array<string>, is_builtin boolean")

    def render(self, name: str, values: dict, now: datetime | None = None) -> dict:
        """Title, content, type and tags; variables without a value are empty."""
        t, now = self.all[name], now or datetime.now()
        known = {"date": f"{now:%Y-%m-%d}", "time": f"{now:%H:%M}", "datetime": f"{now:%Y-%m-%d %H:%M}"} | values
        fill = lambda s: re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(known.get(m.group(1), "")), s)
        return {"title": fill(t["title_format"]), "content": fill(t["content"]), "note_type": t["note_type"], "tags": list(t["tags"])}


def rendered(rows: DataFrame, template: dict, variables: tuple[str, ...] = ("title", "content", "source", "date", "time", "datetime")) -> DataFrame:
    """Rows with ``title`` and ``content`` from a template, by built-in replacement; columns that are missing or null are empty."""

    def fill(text: str):
        parts, out = re.split(r"\{\{\s*(\w+)\s*\}\}", text), []
        for i, p in enumerate(parts):
            known = p in variables and p in rows.columns
            out.append(F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) if known else F.lit(""))
        return F.concat(*out)

    return rows.select(*(c for c in rows.columns if c not in ("title", "content")), fill(template["title_format"]).alias("title"), fill(template["content"]).alias("content"))
