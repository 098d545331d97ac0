"""Compiled help files: the directory, uncompressed and LZX-compressed objects, metadata and reading order."""

from __future__ import annotations

import re
import struct

from verdigris.functions.text import LANGUAGES

EXTRA = [0, 0, 0, 0] + [i // 2 - 1 for i in range(4, 36)] + [17] * 15
BASE = [0]
for _e in EXTRA:
    BASE.append(BASE[-1] + (1 << _e))


class Bits:
    """Bits of little-endian 16-bit words, highest first; zeros after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            pair = self.data[self.at : self.at + 2].ljust(2, b"\0")
            self.at += 2
            self.hold = self.hold << 16 | pair[0] | pair[1] << 8
            self.n += 16

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        out = self.hold >> self.n
        self.hold &= (1 << self.n) - 1
        return out

    def aligned(self, n: int) -> bytes:
        """Raw bytes from the next word on."""
        whole = self.n // 16
        self.at -= 2 * whole
        self.hold = self.n = 0
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


class Codes:
    """A canonical prefix code from code lengths."""

    def __init__(self, lengths: list[int]):
        self.table: dict[tuple[int, int], int] = {}
        code = 0
        for n in range(1, max(lengths, default=0) + 1):
            for symbol, own in enumerate(lengths):
                if own == n:
                    self.table[n, code] = symbol
                    code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            if (found := self.table.get((n, code))) is not None:
                return found
        raise ValueError("bad LZX code")


class Lzx:
    """An LZX decoder whose state spans the blocks between two resets."""

    def __init__(self, window_bits: int):
        slots = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}[window_bits]
        self.window, self.main_size = 1 << window_bits, 256 + 8 * slots
        self.out = bytearray()
        self.recent = [1, 1, 1]
        self.main, self.length = [0] * self.main_size, [0] * 249
        self.kind, self.left, self.started = 0, 0, False
        self.translate = 0

    def _lengths(self, bits: Bits, lengths: list[int], at: int, end: int) -> None:
        pre = Codes([bits.take(4) for _ in range(20)])
        while at < end:
            code = pre.read(bits)
            if code == 17 or code == 18:
                n = 4 + bits.take(4) if code == 17 else 20 + bits.take(5)
                value = 0
            elif code == 19:
                n = 4 + bits.take(1)
                value = (lengths[at] - pre.read(bits)) % 17
            else:
                n, value = 1, (lengths[at] - code) % 17
            for _ in range(min(n, end - at)):
                lengths[at] = value
                at += 1

    def _begin(self, bits: Bits) -> None:
        self.kind, self.left = bits.take(3), bits.take(24)
        if self.kind == 2:
            self.aligned_codes = Codes([bits.take(3) for _ in range(8)])
        if self.kind in (1, 2):
            self._lengths(bits, self.main, 0, 256)
            self._lengths(bits, self.main, 256, self.main_size)
            self._lengths(bits, self.length, 0, 249)
            self.main_codes, self.length_codes = Codes(self.main), Codes(self.length)
        elif self.kind == 3:
            if not bits.n % 16:
                bits.need(bits.n + 16)
                bits.take(16)
            self.recent = list(struct.unpack("<3I", bits.aligned(12)))
        else:
            raise ValueError("bad LZX block")

    def frame(self, data: bytes, size: int) -> bytes:
        """``size`` bytes from one compressed frame."""
        bits, out, begin = Bits(data), self.out, len(self.out)
        if not self.started:
            self.started = True
            self.translate = bits.take(16) << 16 | bits.take(16) if bits.take(1) else 0
        while len(out) - begin < size:
            if not self.left:
                self._begin(bits)
            todo = min(self.left, size - (len(out) - begin))
            stop = len(out) + todo
            if self.kind == 3:
                out += bits.aligned(todo)
            else:
                while len(out) < stop:
                    code = self.main_codes.read(bits)
                    if code < 256:
                        out.append(code)
                        continue
                    slot, n = divmod(code - 256, 8)
                    n = n + 2 if n < 7 else 9 + self.length_codes.read(bits)
                    if slot < 3:
                        back = self.recent[slot]
                        self.recent[slot], self.recent[0] = self.recent[0], back
                    else:
                        extra = EXTRA[slot]
                        if self.kind == 2 and extra >= 3:
                            low = (bits.take(extra - 3) << 3) + self.aligned_codes.read(bits)
                        else:
                            low = bits.take(extra)
                        back = BASE[slot] + low - 2
                        self.recent = [back, self.recent[0], self.recent[1]]
                    if back > len(out) or back < 1:
                        raise ValueError("bad LZX distance")
                    for _ in range(n):
                        out.append(out[-back])
            self.left -= len(out) - stop + todo
        if len(out) > 4 * self.window:
            del out[: len(out) - 2 * self.window]
            begin = len(out) - size
        return bytes(out[begin : begin + size])


class Chm:
    """An archive's objects by path."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"ITSF" or len(raw) < 88:
            raise ValueError("not a compiled help file")
        version = struct.unpack_from("<I", raw, 4)[0]
        if version not in (2, 3):
            raise ValueError(f"help file version {version}")
        self.raw = raw
        self.lcid = struct.unpack_from("<I", raw, 20)[0]
        at, size = struct.unpack_from("<QQ", raw, 72)
        self.base = struct.unpack_from("<Q", raw, 88)[0] if version == 3 and len(raw) >= 96 else at + size
        if raw[at : at + 4] != b"ITSP":
            raise ValueError("no directory")
        head, chunk = struct.unpack_from("<I", raw, at + 8)[0], struct.unpack_from("<I", raw, at + 16)[0]
        page = struct.unpack_from("<i", raw, at + 32)[0]
        self.files: dict[str, tuple[int, int, int]] = {}
        seen: set[int] = set()
        while page >= 0 and page not in seen:
            seen.add(page)
            block = raw[at + head + page * chunk : at + head + (page + 1) * chunk]
            if block[:4] != b"PMGL":
                break
            end = len(block) - struct.unpack_from("<I", block, 4)[0]
            page = struct.unpack_from("<i", block, 16)[0]
            pos = 20
            while pos < end:
                values = []
                pos, n = self._number(block, pos)
                name = block[pos : pos + n].decode("utf-8", "replace")
                pos += n
                for _ in range(3):
                    pos, v = self._number(block, pos)
                    values.append(v)
                self.files[name] = (values[0], values[1], values[2])
        self._content: bytes | None = None

    @staticmethod
    def _number(block: bytes, pos: int) -> tuple[int, int]:
        out = 0
        while True:
            b = block[pos]
            pos += 1
            out = out << 7 | b & 0x7F
            if b < 0x80:
                return pos, out

    def read(self, path: str) -> bytes | None:
        low = {k.lower().lstrip("/"): v for k, v in self.files.items()}
        found = low.get(path.lower().lstrip("/"))
        if found is None:
            return None
        section, at, n = found
        if section == 0:
            return self.raw[self.base + at : self.base + at + n]
        return self.content()[at : at + n]

    def content(self) -> bytes:
        """The compressed section, unpacked once."""
        if self._content is None:
            store = "::DataSpace/Storage/MSCompressed/"
            control = self.read(store + "ControlData")
            table = self.read(store + "Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable")
            packed = self.read(store + "Content")
            if not control or not table or packed is None:
                raise ValueError("no compressed content")
            version, reset, window = struct.unpack_from("<III", control, 8)
            if version == 2:
                reset, window = reset * 0x8000, window * 0x8000
            count, _, head = struct.unpack_from("<III", table, 4)
            total, _, frame = struct.unpack_from("<QQQ", table, 16)
            starts = [*struct.unpack_from(f"<{count}Q", table, head), len(packed)]
            out, lzx = [], None
            every = max(1, reset // frame)
            for i in range(count):
                if i % every == 0:
                    lzx = Lzx(window.bit_length() - 1)
                out.append(lzx.frame(packed[starts[i] : starts[i + 1]], min(frame, total - i * frame)))
            self._content = b"".join(out)
        return self._content

    def metadata(self) -> dict:
        """Title, language, tables of contents and default topic from #SYSTEM, the language also from the header."""
        out: dict = {}
        raw, pos = self.read("#SYSTEM") or b"", 4
        text = lambda b: b.split(b"\0")[0].decode("utf-8", "replace").strip()
        while pos + 4 <= len(raw):
            code, n = struct.unpack_from("<HH", raw, pos)
            body = raw[pos + 4 : pos + 4 + n]
            if len(body) < n:
                break
            name = {0: "contents", 1: "index", 2: "topic", 3: "title"}.get(code)
            if name and text(body):
                out.setdefault(name, text(body))
            elif code == 4 and n >= 4:
                out.setdefault("language", LANGUAGES.get(struct.unpack_from("<I", body)[0]))
            elif code == 6 and text(body):
                out.setdefault("contents", text(body) + ".hhc")
                out.setdefault("index", text(body) + ".hhk")
            pos += 4 + n
        if not out.get("language"):
            out["language"] = LANGUAGES.get(self.lcid)
        return out

    def pages(self) -> list[str]:
        """HTML objects in reading order: by the table of contents, then by path."""
        every = sorted((k for k in self.files if re.search(r"(?i)\.html?$", k) and k[:1] not in ":#$"), key=str.lower)
        by = {k.lower().lstrip("/"): k for k in every}
        contents = self.metadata().get("contents") or next((k for k in self.files if k.lower().endswith(".hhc")), None)
        order: list[str] = []
        if contents and (toc := self.read(contents)):
            for target in re.findall(r'(?i)name="Local"\s+value="([^"#]*)', toc.decode("utf-8", "replace")):
                if (found := by.get(target.lower().lstrip("/"))) and found not in order:
                    order.append(found)
        return order or every

    def tags(self) -> list[str]:
        """Index words, without targets."""
        index = self.metadata().get("index")
        raw = self.read(index) if index else None
        found = re.findall(r'(?i)<param\s+name="?Name"?\s+value="([^"]*)"', raw.decode("utf-8", "replace")) if raw else []
        out: dict[str, str] = {}
        for f in found:
            if f.strip() and ".htm" not in f.lower() and f != "Index":
                out.setdefault(f.strip().lower(), f.strip())
        return list(out.values())
