"""Manifests of committed files, one for each job that wrote to a folder.

A manifest lists the files of a job's winning tasks; only listed files exist for a reader. A job that
appends adds a manifest. One that overwrites names those it replaces, so a reader changes over at one
moment, and then deletes them with their files.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

Entry = list  # a file's name, then whatever its reader needs


def _load(store: fs.FileSystem, root: str, label: str) -> dict[str, dict]:
    if store.get_file_info(root).type != fs.FileType.Directory:
        return {}
    found = {}
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith(f"_{label}-") and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    replaced = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in sorted(found.items()) if name not in replaced}


def publish(path: str, label: str, entries: list[Entry], overwrite: bool = False) -> None:
    """Make a job's files part of the folder, or all there is of it."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    old = _load(store, root, label) if overwrite else {}
    draft, name = f"{root}/.{uuid.uuid4().hex}", f"_{label}-{uuid.uuid4().hex}.json"
    with store.open_output_stream(draft) as out:
        out.write(json.dumps({"replaces": [*old], "entries": entries}).encode())
    store.move(draft, f"{root}/{name}")
    for manifest, content in old.items():
        for entry in content["entries"]:
            store.delete_file(f"{root}/{entry[0]}")
        store.delete_file(f"{root}/{manifest}")


def committed(path: str, label: str) -> list[Entry] | None:
    """The files that a folder consists of; None if no job has published there."""
    store, root = fs.FileSystem.from_uri(path)
    found = _load(store, root, label)
    return [e for m in found.values() for e in m["entries"]] if found else None
