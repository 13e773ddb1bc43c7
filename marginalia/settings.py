"""Files of an installation: the registry of knowledge bases, the settings of each base, templates, and recorded durations.

They are small and lie on the driver's file system. Every write goes to a new file that then takes the place of the old one.
"""

from __future__ import annotations

import json
import logging
import os
import tempfile
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import yaml

from marginalia import admin
from marginalia.operators import metrics

log = logging.getLogger(__name__)
#: Names a knowledge base where none is given.
BASE_VARIABLE = "MARGINALIA_KB"
#: The folder of the installation where none is given.
HOME_VARIABLE = "MARGINALIA_HOME"


def replace(path: Path, text: str) -> None:
    """Write a file whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, new = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(new, path)


def dumped(data: dict) -> str:
    return yaml.safe_dump(data, allow_unicode=True, sort_keys=False)


@dataclass
class Settings:
    """Settings of one knowledge base. ``settable`` are those that a command may change."""

    embedding_model: str = "hashed-bag"
    embedding_dimension: int = 384
    device: str = "auto"
    batch_size: int = 32
    default_semantic_top: int = 5
    default_graph_hops: int = 2
    similarity_threshold: float = 0.6
    auto_sync: bool = False
    sync_interval: int = 300

    settable = ("device", "embedding_model", "batch_size")

    @classmethod
    def load(cls, path: Path) -> Settings:
        """The settings of a YAML file; defaults for what it doesn't name, or where there is none."""
        found = (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {}
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})

    def save(self, path: Path) -> None:
        replace(path, dumped(asdict(self)))

    def set(self, key: str, value: str) -> None:
        if key not in self.settable:
            raise ValueError(f"setting {key}; one of {', '.join(self.settable)}")
        if key == "batch_size":
            if not value.isdigit() or int(value) < 1:
                raise ValueError(f"batch_size {value!r} is not a positive whole number")
            value = int(value)
        setattr(self, key, value)


class TemplateFolder(admin.Templates):
    """Templates as one YAML file each, with the built-in ones; files that don't hold a template are passed over."""

    def __init__(self, folder: Path):
        self.folder, own = folder, {}
        for path in sorted(folder.glob("*.yaml")):
            try:
                t = yaml.safe_load(path.read_text(encoding="utf-8"))
                own[t.get("name", path.stem)] = {"description": t.get("description", ""), "note_type": t.get("note_type", "fleeting"), "title_format": t.get("title_format", "{{title}}"), "content": t.get("content", ""), "tags": list(t.get("tags") or [])}
            except (yaml.YAMLError, AttributeError, TypeError, UnicodeDecodeError):
                log.warning("%s holds no template", path)
        super().__init__(own)

    def _file(self, name: str) -> Path:
        if not name or Path(name).name != name:
            raise ValueError(f"{name!r} can't name a template")
        return self.folder / f"{name}.yaml"

    def create(self, name: str, template: dict, force: bool = False) -> None:
        path = self._file(name)
        super().create(name, template, force)
        replace(path, dumped({"name": name, **template, "is_builtin": False}))

    def remove(self, name: str) -> None:
        super().remove(name)
        self._file(name).unlink(missing_ok=True)


class Home:
    """The folder of an installation: ``registry.json``, ``templates/``, ``perf.jsonl``, and by default the knowledge bases themselves."""

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder or os.environ.get(HOME_VARIABLE) or Path.home() / ".marginalia").expanduser().absolute()
        self.file = self.folder / "registry.json"
        if self.file.exists():
            self.registry = admin.Registry.from_json(self.file.read_text(encoding="utf-8"))
        else:
            self.registry = admin.Registry(str(self.folder))

    def save(self) -> None:
        replace(self.file, self.registry.to_json())

    def base(self, name: str | None = None) -> dict:
        """The named base, else that of the environment, else the default one, which is made if there is none yet."""
        if not self.registry.bases:
            self.create("default")
        name = name or os.environ.get(BASE_VARIABLE) or None
        if name is not None and name not in self.registry.bases:
            raise KeyError(f"no knowledge base {name}")
        return self.registry.current(name)

    def create(self, name: str, path: str | None = None, description: str | None = None, make_default: bool = False) -> dict:
        self.registry.create(name, path, description, make_default)
        base = self.registry.bases[name]
        Path(base["path"]).mkdir(parents=True, exist_ok=True)
        Settings().save(self.settings_file(base))
        self.save()
        return base

    def remove(self, name: str, delete_data: bool = False) -> dict:
        """Take a base out of the registry, and on demand its folder; that of the default base is never deleted."""
        import shutil

        was_default = self.registry.default == name
        gone = self.registry.remove(name)
        self.save()
        if delete_data and not was_default:
            shutil.rmtree(gone["path"], ignore_errors=True)
        return gone

    @staticmethod
    def settings_file(base: dict) -> Path:
        return Path(base["path"]) / "config.yaml"

    def settings(self, base: dict) -> Settings:
        return Settings.load(self.settings_file(base))

    @property
    def templates(self) -> TemplateFolder:
        return TemplateFolder(self.folder / "templates")

    @property
    def perf(self) -> Path:
        return self.folder / "perf.jsonl"

    def recorded(self, recorder: metrics.Recorder) -> None:
        """Append durations to the installation's record."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with self.perf.open("a", encoding="utf-8") as f:
            f.writelines(json.dumps({"op": op, "duration": duration}) + "\n" for op, duration in recorder.rows)
