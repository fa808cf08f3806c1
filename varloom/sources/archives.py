"""Files and archives on the driver's side: checked copies, unpacking, packing. For small bundles around the tables, not for tables."""

from __future__ import annotations

import gzip
import hashlib
import shutil
import tarfile
import zipfile
from pathlib import Path


def md5(path: str | Path) -> str:
    h = hashlib.md5()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def checked_copy(source: str | Path, target: str | Path, expected_md5: str | None = None) -> Path:
    """Copies a file; another checksum than the expected one raises and leaves nothing behind."""
    target = Path(target)
    work = target.with_name(target.name + ".part")
    shutil.copyfile(source, work)
    if expected_md5 and md5(work) != expected_md5:
        work.unlink()
        raise ValueError(f"{source} has another checksum than expected")
    work.replace(target)
    return target


def gunzip(source: str | Path, target: str | Path) -> Path:
    with gzip.open(source, "rb") as a, open(target, "wb") as b:
        shutil.copyfileobj(a, b)
    return Path(target)


def untar(source: str | Path, folder: str | Path, mode: str = "r:*") -> Path:
    """Unpacks an archive; members that would land outside the folder raise."""
    with tarfile.open(source, mode) as t:
        t.extractall(folder, filter="data")
    return Path(folder)


def unzip(source: str | Path, folder: str | Path, member: str | None = None) -> Path:
    """Unpacks everything, or one member, whose path is returned."""
    with zipfile.ZipFile(source) as z:
        if member:
            return Path(z.extract(member, folder))
        z.extractall(folder)
    return Path(folder)


def zip_folder(folder: str | Path, target: str | Path) -> Path:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(folder).rglob("*")):
            z.write(p, p.relative_to(folder))
    return Path(target)


def promote(folder: str | Path, inside: str, target: str | Path) -> Path:
    """Copies one file out of a folder."""
    return checked_copy(Path(folder) / inside, target)


def collect_files(sources: dict[str, str | Path], folder: str | Path) -> Path:
    """Copies files into a folder under given names."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, p in sources.items():
        checked_copy(p, Path(folder) / name)
    return Path(folder)
