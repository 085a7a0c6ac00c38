"""Files by URI."""

from __future__ import annotations

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def listed(uri: str, suffix: str) -> list[str]:
    """The files that a path names: itself, or all with the suffix in a folder, by name."""
    fs, path = locate(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(suffix))
        scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
        return [scheme + p if scheme else p for p in found]
    return [uri]


def sized(uris: list[str]) -> list[int]:
    """Bytes of each file."""
    out = []
    for uri in uris:
        fs, path = locate(uri)
        out.append(fs.get_file_info(path).size)
    return out
