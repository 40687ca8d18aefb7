"""Linked libraries, symbols and constants of ELF binaries, and members of image tarballs, read from bytes in Arrow batches."""

from __future__ import annotations

import io
import json
import struct
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from keelson.operators.detection import CALLS

#: Bytes of a binary and of a member that is read.
ELF_CAP, MEMBER_CAP = 512 << 20, 64 << 20
# Starts of tables that algorithms carry, as hex.
CONSTANTS = {
    "const.aes.sbox": ("AES", "637c777bf26b6fc53001672bfed7ab76"), "const.aes.inv_sbox": ("AES", "52096ad53036a538bf40a39e81f3d7fb"), "const.aes.te0": ("AES", "c66363a5f87c7c84ee777799f67b7b8d"),
    "const.sha256.k": ("SHA-2", "428a2f9871374491b5c0fbcfe9b5dba5"), "const.sha512.k": ("SHA-2", "428a2f98d728ae227137449123ef65cd"), "const.sha1.k": ("SHA-1", "5a8279996ed9eba18f1bbcdcca62c1d6"),
    "const.md5.t": ("MD5", "78a46ad756b7c7e8db702024eecebdc1"), "const.md5.t_be": ("MD5", "d76aa478e8c7b756242070dbc1bdceee"), "const.des.sbox1": ("DES", "0e040d01020f0b08030a060c05090007"),
    "const.blowfish.p": ("Blowfish", "243f6a8885a308d313198a2e03707344"), "const.chacha20.sigma": ("ChaCha20", "657870616e642033322d62797465206b"), "const.sha3.rc": ("SHA-3", "01000000000000008280000000000000"),
}
DATA_SECTIONS = (".rodata", ".data.rel.ro", ".rdata", ".data")
PACKAGE_DATABASES = ("var/lib/dpkg/status", "lib/apk/db/installed")


class NotElf(Exception):
    pass


def sections(data: bytes) -> dict[str, tuple[int, int, int, int, bytes]]:
    """name to (type, link, address, entry size, bytes) of an ELF file of either size and byte order."""
    if data[:4] != b"\x7fELF" or len(data) < 52:
        raise NotElf("no ELF header")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    try:
        off, = struct.unpack_from(order + ("Q" if wide else "I"), data, 0x28 if wide else 0x20)
        size, count, names_at = struct.unpack_from(order + "HHH", data, 0x3A if wide else 0x2E)
        heads = []
        for i in range(count):
            f = struct.unpack_from(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), data, off + i * size)
            heads.append((f[0], f[1], f[6], f[3], f[9], data[f[4] : f[4] + f[5]] if f[1] != 8 else b""))
        names = heads[names_at][5] if heads else b""
    except (struct.error, IndexError) as e:
        raise NotElf(f"bad section header: {e}") from e
    out = {}
    for i, (name, kind, link, addr, entry, content) in enumerate(heads):
        label = names[name : names.find(b"\0", name)].decode("latin-1")
        out[label if label not in out else f"{label}#{i}"] = (kind, link, addr, entry, content)
    out["\0all"] = (0, 0, 0, 0, json.dumps(list(out)).encode())
    return out


def facts(data: bytes) -> list[tuple[str, str, str, int]]:
    """(kind, name, algorithm, offset): needed libraries, symbols that the call rules know, and constants, each once."""
    secs = sections(data)
    order = json.loads(secs.pop("\0all")[4])
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    text = lambda strings, at: strings[at : strings.find(b"\0", at)].decode("latin-1")
    out = []
    for label in order:
        kind, link, _, _, content = secs[label]
        strings = secs[order[link]][4] if link < len(order) else b""
        if kind == 6:
            pair = struct.Struct(end + ("qQ" if wide else "iI"))
            out += [("needed", text(strings, v), "", 0) for tag, v in pair.iter_unpack(content[: len(content) // pair.size * pair.size]) if tag == 1]
        elif kind in (2, 11):
            step = 24 if wide else 16
            seen = {text(strings, struct.unpack_from(end + "I", content, at)[0]) for at in range(0, len(content) - step + 1, step)}
            out += [("symbol", s, CALLS["c"][s][0], 0) for s in sorted(seen) if s in CALLS["c"]]
    for name, (algorithm, needle) in CONSTANTS.items():
        for label in DATA_SECTIONS:
            if label in secs and (at := secs[label][4].find(bytes.fromhex(needle))) >= 0:
                out.append(("constant", name, algorithm, secs[label][2] + at))
                break
    return list(dict.fromkeys(out))


_FACTS = "target_id string, path string, layer_digest string, kind string, name string, algorithm string, byte_offset bigint, error string"


def elf_facts(files: DataFrame) -> DataFrame:
    """The facts of the files that begin like an ELF binary; a file that can't be read has one row with its error.

    files: target_id, path, content, and layer_digest or none. Null contents and files over ELF_CAP are left out.
    """
    if "layer_digest" not in files.columns:
        files = files.selectExpr("target_id", "path", "content", "CAST(NULL AS STRING) AS layer_digest")
    some = files.filter(f"length(content) <= {ELF_CAP} AND substring(content, 1, 4) = X'7F454C46'").select("target_id", "path", "layer_digest", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, p, d, c in zip(pdf["target_id"], pdf["path"], pdf["layer_digest"], pdf["content"]):
                try:
                    rows += [(t, p, d, *f, None) for f in facts(bytes(c))]
                except (NotElf, struct.error, ValueError) as e:
                    rows.append((t, p, d, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["target_id", "path", "layer_digest", "kind", "name", "algorithm", "byte_offset", "error"])

    return some.mapInPandas(read, _FACTS)


def members(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(layer digest, name, content) of the regular members of an image tarball's layers, or of the tarball itself."""
    with tarfile.open(fileobj=io.BytesIO(data)) as outer:
        names = {m.name: m for m in outer.getmembers() if m.isfile()}
        layers: list[str] = []
        if "manifest.json" in names:
            layers = [layer for entry in json.load(outer.extractfile(names["manifest.json"])) for layer in entry.get("Layers", [])]
        layers = layers or sorted(n for n in names if n.startswith("blobs/sha256/"))
        if not layers:
            yield from ((("", n, outer.extractfile(m).read()) for n, m in names.items() if m.size <= MEMBER_CAP))
            return
        for layer in layers:
            parts = layer.split("/")
            digest = next((p for p in parts if len(p) == 64 and set(p) <= set("0123456789abcdef")), parts[0])
            if layer not in names:
                yield f"!{digest}", "layer missing", b""
                continue
            try:
                with tarfile.open(fileobj=io.BytesIO(outer.extractfile(names[layer]).read())) as inner:
                    for m in inner.getmembers():
                        if m.isfile() and m.size <= MEMBER_CAP:
                            yield digest, m.name.removeprefix("./"), inner.extractfile(m).read()
            except tarfile.TarError as e:
                yield f"!{digest}", str(e), b""


def image_members(images: DataFrame) -> DataFrame:
    """target_id, layer_digest, path, content, error of the members that can matter: binaries and package databases."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, c in zip(pdf["target_id"], pdf["content"]):
                rows = []
                try:
                    for digest, name, content in members(bytes(c)):
                        if digest[:1] == "!":
                            rows.append((t, digest[1:], None, None, name))
                        elif content[:4] == b"\x7fELF" or name in PACKAGE_DATABASES:
                            rows.append((t, digest, name, content, None))
                except (tarfile.TarError, ValueError) as e:
                    rows.append((t, None, None, None, f"cannot open image: {e}"))
                yield pd.DataFrame(rows, columns=["target_id", "layer_digest", "path", "content", "error"])

    return images.filter("content IS NOT NULL").select("target_id", "content").mapInPandas(read, "target_id string, layer_digest string, path string, content binary, error string")


def files_under(spark, root: str, pattern: str = "*", most: int = 256 << 20) -> DataFrame:
    """path, length, content of the files below root, without those in folders of tools and over most bytes."""
    skip = r"/(\.git|\.hg|\.svn|node_modules|__pycache__|\.venv|venv|\.tox|\.mypy_cache|\.pytest_cache|\.idea|\.vscode)/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.filter((df["length"] <= most) & ~df["path"].rlike(skip)).select("path", "length", "content")
