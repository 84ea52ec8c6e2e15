"""WARC 1.1 records: bytes of a record, and reading records header first."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

VERSION = b"WARC/1.1"
LINE = b"\r\n"
HEAD_BYTES = 64 * 1024
# Fixed value: the profile that names revisits of equal payloads.
EQUAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(block), b""]
    return LINE.join(lines) + LINE + block + LINE + LINE


def http_block(payload: bytes | None, length: int) -> bytes:
    """An HTTP answer; without its payload for a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    return head + (payload or b"")


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that says its own length in an extra field (sl: compressed, plain), so readers can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str] | None:
    """Names in lower case; a line that begins with white space goes on with the one before. None: no WARC record."""
    lines = head.split(LINE)
    if not lines[0].startswith(b"WARC/"):
        return None
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, value = line.split(b":", 1)
            name = key.strip().decode("utf-8", "replace").lower()
            headers[name] = value.strip().decode("utf-8", "replace")
    return headers


Wanted = Callable[[dict[str, str]], bool]


def records(file: BinaryIO, end: int | None, wanted: Wanted, blocks: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of the wanted records that begin before `end`, from the place of `file` on.

    Only headers are decoded first; a record that is not wanted, or whose block is not asked for, is stepped over.
    """
    while end is None or file.tell() < end:
        start = file.tell()
        head = file.read(18)
        if not head:
            return
        if head[:2] != b"\x1f\x8b":
            file.seek(start)
            yield from _plain(file, end, wanted, blocks)
            return
        length = None
        if len(head) == 18 and head[3] == 4 and head[12:14] == b"sl":
            body, = struct.unpack("<I", file.read(8)[:4])
            length = 10 + 2 + 12 + body
        file.seek(start)
        unpacker, data = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in data and not unpacker.eof and (part := file.read(4096)):
            data += unpacker.decompress(part)
        headers = parse_headers(data.split(b"\r\n\r\n", 1)[0])
        take = headers is not None and wanted(headers)
        if length is not None and not (take and blocks):
            file.seek(start + length)
        else:
            parts = [data]
            while not unpacker.eof and (part := unpacker.unconsumed_tail or file.read(1 << 18)):
                parts.append(unpacker.decompress(part))
            file.seek(file.tell() - len(unpacker.unused_data))
            data = b"".join(parts)
        if take:
            begin = data.find(b"\r\n\r\n") + 4
            yield headers, data[begin:begin + int(headers.get("content-length", 0))] if blocks else None


def _plain(file: BinaryIO, end: int | None, wanted: Wanted, blocks: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while end is None or file.tell() < end:
        start, head = file.tell(), b""
        while b"\r\n\r\n" not in head and (part := file.read(4096)):
            head += part
        if not head.strip():
            return
        skipped = len(head) - len(head.lstrip(b"\r\n"))
        head = head[skipped:]
        size = head.find(b"\r\n\r\n") + 4
        headers = parse_headers(head[:size])
        if size < 4 or headers is None:
            raise ValueError(f"no WARC record at byte {start}")
        length, at = int(headers.get("content-length", 0)), start + skipped + size
        block = None
        if (take := wanted(headers)) and blocks:
            file.seek(at)
            block = file.read(length)
        file.seek(at + length + 4)
        if take:
            yield headers, block


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.split(b"\r\n\r\n", 1)[1] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block


def open_range(file: BinaryIO, start: int) -> BinaryIO:
    file.seek(start)
    return io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file
