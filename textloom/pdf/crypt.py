"""The standard security handler: RC4 and AES, without any crypto package."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

from .syntax import Dict, Name, PdfError, Text, integer

#: The padding of passwords (fixed value of the public format).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ (0x11B if x & 128 else 0)) & 255


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


def _box() -> list[int]:
    """The substitution box, from inverses in the field and an affine map."""
    box = []
    for x in range(256):
        inverse = next((y for y in range(1, 256) if _times(x, y) == 1), 0)
        v = 0x63
        for turn in range(5):
            v ^= (inverse << turn | inverse >> (8 - turn)) & 255
        box.append(v)
    return box


def _aes_tables() -> tuple:
    """The substitution box; four tables of substituted, mixed columns; the box turned round; products for the way back."""
    box = _box()
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    column = [_times(v, 2) << 24 | v << 16 | v << 8 | _times(v, 3) for v in box]
    mixed = [[(w >> 8 * i | w << 32 - 8 * i) & 0xFFFFFFFF for w in column] for i in range(4)]
    return box, mixed, back, {m: np.array([_times(x, m) for x in range(256)], np.uint8) for m in (9, 11, 13, 14)}


class Aes:
    """AES with keys of 16 or 32 bytes, block by block and in CBC mode."""

    _tables: tuple | None = None

    def __init__(self, key: bytes):
        if len(key) not in (16, 32):
            raise PdfError("an AES key of this size is not supported")
        if Aes._tables is None:
            Aes._tables = _aes_tables()
        self.box, self.mixed = Aes._tables[:2]
        n = len(key) // 4
        words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        while len(words) < 4 * (n + 7):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [self.box[x] for x in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _double(rcon)
            elif n > 6 and len(words) % n == 4:
                w = [self.box[x] for x in w]
            words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
        self.words = [int.from_bytes(bytes(w), "big") for w in words]
        self.keys = np.array(words, np.uint8).reshape(-1, 16)

    def encrypt_block(self, block: bytes) -> bytes:
        """On four words; a table holds what a byte becomes and adds to its column in a whole round."""
        t0, t1, t2, t3 = self.mixed
        k, box, last = self.words, self.box, len(self.words) - 4
        a, b, c, d = (int.from_bytes(block[i : i + 4], "big") ^ k[i // 4] for i in (0, 4, 8, 12))
        for r in range(4, last, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[r], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[r + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[r + 2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[r + 3],
            )
        turned = ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))
        out = ((box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k[last + i] for i, (w, x, y, z) in enumerate(turned))
        return b"".join(w.to_bytes(4, "big") for w in out)

    def decrypt_blocks(self, data: bytes) -> np.ndarray:
        """All blocks at once, a row each."""
        _, _, back, by = Aes._tables
        order = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])
        s = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ self.keys[-1]
        for r in range(len(self.keys) - 2, -1, -1):
            s = back[s[:, order]] ^ self.keys[r]
            if r:
                columns = s.reshape(-1, 4, 4)
                s = np.bitwise_xor.reduce([by[m][np.roll(columns, -i, axis=2)] for i, m in enumerate((14, 11, 13, 9))]).reshape(-1, 16)
        return s

    def decrypt_block(self, block: bytes) -> bytes:
        return self.decrypt_blocks(block).tobytes()

    def cbc(self, iv: bytes, data: bytes, encrypt: bool) -> bytes:
        data = data[: len(data) // 16 * 16]
        if not encrypt:
            before = np.frombuffer(iv + data, np.uint8)[: len(data)].reshape(-1, 16)
            return (self.decrypt_blocks(data) ^ before).tobytes()
        out, last = [], int.from_bytes(iv, "big")
        for at in range(0, len(data), 16):
            out.append(self.encrypt_block((int.from_bytes(data[at : at + 16], "big") ^ last).to_bytes(16, "big")))
            last = int.from_bytes(out[-1], "big")
        return b"".join(out)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """Data after its initial vector; padding is removed only if it is sound."""
    if len(data) < 32:
        return b""
    out = Aes(key).cbc(data[:16], data[16:], False)
    n = out[-1]
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else out


def aes_encrypt(key: bytes, data: bytes, salt: bytes) -> bytes:
    """The initial vector comes from the salt and the data, so that a run can be repeated."""
    iv = hashlib.md5(salt + key + data).digest()
    n = 16 - len(data) % 16
    return iv + Aes(key).cbc(iv, data + bytes([n]) * n, True)


@functools.lru_cache(maxsize=64)
def hardened(revision: int, password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    turn = 0
    while True:
        e = Aes(k[:16]).cbc(k[16:32], (password + k + user) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        turn += 1
        if turn >= 64 and e[-1] <= turn - 32:
            return k[:32]


class Crypt:
    """Keys of one document; methods are None, "rc4", "aes128" and "aes256"."""

    def __init__(self, d: Dict, first_id: bytes, password: str | None):
        if d.get(b"Filter") != b"Standard":
            raise PdfError("only the standard security handler is supported")
        self.version, self.revision = integer(d.get(b"V")) or 0, integer(d.get(b"R")) or 0
        self.metadata = d.get(b"EncryptMetadata") is not False
        self.strings = self.streams = "rc4"
        if self.version in (4, 5):
            self.strings, self.streams = (self._method(d, d.get(k)) for k in (b"StrF", b"StmF"))
        elif self.version not in (1, 2):
            raise PdfError(f"encryption version {self.version} is not supported")
        given = (password or "").encode()
        data = lambda k: v.data if isinstance(v := d.get(k), Text) else b""
        o, u = data(b"O"), data(b"U")
        if self.version == 5:
            self.key = self._key_256(given[:127], o, u, data(b"OE"), data(b"UE"))
        else:
            bits = integer(d.get(b"Length")) or (128 if self.version == 4 else 40)
            n = 5 if self.revision == 2 else max(5, min(16, bits // 8 if bits >= 40 else bits))
            flags = ((integer(d.get(b"P")) or 0) & 0xFFFFFFFF).to_bytes(4, "little")
            latin = (password or "").encode("latin-1", "replace")
            self.key = next((k for p in (latin, self._owner(latin, o, n)) if self._is_user(k := self._user_key(p, o, flags, first_id, n), u, first_id)), None)
        if self.key is None:
            raise PdfError("the password is not correct" if password else "the document needs a password")

    @staticmethod
    def _method(d: Dict, name) -> str | None:
        if name is None or name == b"Identity":
            return None
        filters = d.get(b"CF")
        f = filters.get(name) if isinstance(filters, Dict) else None
        kind = f.get(b"CFM") if isinstance(f, Dict) else None
        methods = {b"None": None, None: None, b"V2": "rc4", b"AESV2": "aes128", b"AESV3": "aes256"}
        if kind not in methods:
            raise PdfError("an unknown crypt filter")
        return methods[kind]

    def _key_256(self, p: bytes, o: bytes, u: bytes, oe: bytes, ue: bytes) -> bytes | None:
        zero = bytes(16)
        if hardened(self.revision, p, u[32:40]) == u[:32]:
            return Aes(hardened(self.revision, p, u[40:48])).cbc(zero, ue[:32], False)
        if hardened(self.revision, p, o[32:40], u[:48]) == o[:32]:
            return Aes(hardened(self.revision, p, o[40:48], u[:48])).cbc(zero, oe[:32], False)
        return None

    def _user_key(self, p: bytes, o: bytes, flags: bytes, first_id: bytes, n: int) -> bytes:
        h = hashlib.md5((p + PAD)[:32] + o[:32] + flags + first_id + (b"" if self.metadata or self.revision < 4 else b"\xff" * 4)).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            h = hashlib.md5(h[:n]).digest()
        return h[:n]

    def _is_user(self, key: bytes, u: bytes, first_id: bytes) -> bool:
        if self.revision == 2:
            return rc4(key, PAD) == u[:32]
        h = hashlib.md5(PAD + first_id).digest()
        for i in range(20):
            h = rc4(bytes(k ^ i for k in key), h)
        return h == u[:16]

    def _owner(self, p: bytes, o: bytes, n: int) -> bytes:
        h = hashlib.md5((p + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            h = hashlib.md5(h).digest()
        out = o[:32]
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            out = rc4(bytes(k ^ i for k in h[:n]), out)
        return out

    def apply(self, method: str | None, num: int, gen: int, data: bytes, encrypt: bool) -> bytes:
        if method is None:
            return data
        key = self.key
        if method != "aes256":
            seed = key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if method == "aes128" else b"")
            key = hashlib.md5(seed).digest()[: min(16, len(key) + 5)]
        if method == "rc4":
            return rc4(key, data) if data else data
        return aes_encrypt(key, data, b"%d %d" % (num, gen)) if encrypt else aes_decrypt(key, data)

    def stream_method(self, d: Dict) -> str | None:
        if d.get(b"Type") == b"XRef" or d.get(b"Type") == b"Metadata" and not self.metadata:
            return None
        filters = d.get(b"Filter")
        return None if filters == b"Crypt" or isinstance(filters, list) and Name(b"Crypt") in filters else self.streams

    def walk(self, value, num: int, gen: int, encrypt: bool):
        """The value with every string in it turned."""
        if isinstance(value, Text):
            return Text(self.apply(self.strings, num, gen, value.data, encrypt), value.hex)
        if isinstance(value, list):
            return [self.walk(v, num, gen, encrypt) for v in value]
        if isinstance(value, Dict):
            return Dict([(k, self.walk(v, num, gen, encrypt)) for k, v in value.items])
        return value
