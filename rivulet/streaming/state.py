"""Key/value stores of processors and the typed states built on them.

A store sees bytes only; ``Backend`` is whatever keeps them: a dict, or Spark's
map state within a running query. Keys are ordered bytewise.
"""

from __future__ import annotations

import json
import pickle
import struct
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class Backend(ABC):
    @abstractmethod
    def get(self, key: bytes) -> bytes | None: ...

    @abstractmethod
    def put(self, key: bytes, value: bytes) -> None: ...

    @abstractmethod
    def delete(self, key: bytes) -> None: ...

    @abstractmethod
    def items(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries, in any order."""


class DictBackend(Backend):
    def __init__(self) -> None:
        self.held: dict[bytes, bytes] = {}

    def get(self, key: bytes) -> bytes | None:
        return self.held.get(key)

    def put(self, key: bytes, value: bytes) -> None:
        self.held[key] = value

    def delete(self, key: bytes) -> None:
        self.held.pop(key, None)

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        return iter(list(self.held.items()))


@dataclass(frozen=True)
class ComplexKey:
    """A key in four parts; the first three select a group, the last orders within it."""

    key_group: bytes
    key: bytes
    namespace: bytes = b""
    user_key: bytes = b""

    def prefix(self) -> bytes:
        return b"\x01" + b"".join(struct.pack(">I", len(x)) + x for x in (self.key_group, self.key, self.namespace))

    def encoded(self) -> bytes:
        return self.prefix() + self.user_key


class KvStore:
    """Plain and complex keys of one named store."""

    def __init__(self, backend: Backend) -> None:
        self.backend = backend

    def put_state(self, key: bytes, value: bytes) -> None:
        self.backend.put(b"\x00" + key, value)

    def get_state(self, key: bytes) -> bytes | None:
        return self.backend.get(b"\x00" + key)

    def delete_state(self, key: bytes) -> None:
        self.backend.delete(b"\x00" + key)

    def list_states(self, start: bytes, end: bytes) -> list[bytes]:
        """Keys from start up to, without, end."""
        return sorted(k[1:] for k, _ in self.backend.items() if k[:1] == b"\x00" and start <= k[1:] < end)

    def put(self, key: ComplexKey, value: bytes) -> None:
        self.backend.put(key.encoded(), value)

    def get(self, key: ComplexKey) -> bytes | None:
        return self.backend.get(key.encoded())

    def delete(self, key: ComplexKey) -> None:
        self.backend.delete(key.encoded())

    def merge(self, key: ComplexKey, value: bytes) -> None:
        """Append to what is there."""
        self.backend.put(key.encoded(), (self.backend.get(key.encoded()) or b"") + value)

    def delete_prefix(self, key: ComplexKey) -> None:
        for k, _ in list(self.backend.items()):
            if k.startswith(key.encoded()):
                self.backend.delete(k)

    def list_complex(self, key_group: bytes, key: bytes, namespace: bytes, start: bytes, end: bytes) -> list[bytes]:
        return [k for k, _ in self.scan_complex(key_group, key, namespace) if start <= k < end]

    def scan_complex(self, key_group: bytes, key: bytes, namespace: bytes) -> Iterator[tuple[bytes, bytes]]:
        prefix = ComplexKey(key_group, key, namespace).prefix()
        return iter(sorted((k[len(prefix) :], v) for k, v in self.backend.items() if k.startswith(prefix)))


@dataclass(frozen=True)
class Codec:
    encode: Callable[[Any], bytes]
    decode: Callable[[bytes], Any]


#: Order of encoded bytes is the order of values for bool, ints and floats.
CODECS = {
    "bool": Codec(lambda x: bytes([bool(x)]), lambda b: b != b"\x00"),
    "int64": Codec(lambda x: struct.pack(">Q", (x + (1 << 63)) & (1 << 64) - 1), lambda b: struct.unpack(">Q", b)[0] - (1 << 63)),
    "int32": Codec(lambda x: struct.pack(">I", (x + (1 << 31)) & (1 << 32) - 1), lambda b: struct.unpack(">I", b)[0] - (1 << 31)),
    "float64": Codec(lambda x: _float_bytes(x), lambda b: _bytes_float(b)),
    "string": Codec(lambda x: x.encode(), lambda b: b.decode()),
    "bytes": Codec(bytes, bytes),
    "json": Codec(lambda x: json.dumps(x).encode(), json.loads),
    "pickle": Codec(pickle.dumps, pickle.loads),
}


def _float_bytes(x: float) -> bytes:
    n = struct.unpack(">Q", struct.pack(">d", x))[0]
    return struct.pack(">Q", n ^ ((1 << 64) - 1) if n >> 63 else n | 1 << 63)


def _bytes_float(b: bytes) -> float:
    n = struct.unpack(">Q", b)[0]
    return struct.unpack(">d", struct.pack(">Q", n & (1 << 63) - 1 if n >> 63 else n ^ (1 << 64) - 1))[0]


class _Typed:
    """A state's place: store, name, and the key it is for (empty if unkeyed)."""

    def __init__(self, store: KvStore, name: str, codec: str | Codec = "pickle", key: bytes = b"") -> None:
        self.store, self.codec = store, CODECS[codec] if isinstance(codec, str) else codec
        self.group, self.key = name.encode(), key

    def _at(self, user: bytes = b"", space: bytes = b"") -> ComplexKey:
        return ComplexKey(self.group, self.key, space, user)

    def clear(self) -> None:
        for k, _ in list(self.store.scan_complex(self.group, self.key, b"")):
            self.store.delete(self._at(k))


class ValueState(_Typed):
    def value(self) -> Any:
        raw = self.store.get(self._at())
        return None if raw is None else self.codec.decode(raw)

    def update(self, value: Any) -> None:
        self.store.put(self._at(), self.codec.encode(value))


class ListState(_Typed):
    """Values in the order of their coming; an addition is one append."""

    def add(self, value: Any) -> None:
        raw = self.codec.encode(value)
        self.store.merge(self._at(), struct.pack(">I", len(raw)) + raw)

    def get(self) -> list[Any]:
        raw, out, at = self.store.get(self._at()) or b"", [], 0
        while at < len(raw):
            n = struct.unpack_from(">I", raw, at)[0]
            out.append(self.codec.decode(raw[at + 4 : at + 4 + n]))
            at += 4 + n
        return out

    def update(self, values: list[Any]) -> None:
        self.clear()
        for v in values:
            self.add(v)


class MapState(_Typed):
    def __init__(self, store: KvStore, name: str, key_codec: str = "string", codec: str | Codec = "pickle", key: bytes = b"") -> None:
        super().__init__(store, name, codec, key)
        self.keys_codec = CODECS[key_codec]

    def put(self, key: Any, value: Any) -> None:
        self.store.put(self._at(self.keys_codec.encode(key)), self.codec.encode(value))

    def get(self, key: Any) -> Any:
        raw = self.store.get(self._at(self.keys_codec.encode(key)))
        return None if raw is None else self.codec.decode(raw)

    def remove(self, key: Any) -> None:
        self.store.delete(self._at(self.keys_codec.encode(key)))

    def items(self) -> list[tuple[Any, Any]]:
        return [(self.keys_codec.decode(k), self.codec.decode(v)) for k, v in self.store.scan_complex(self.group, self.key, b"")]


class PriorityQueueState(_Typed):
    """Least first, by the bytes of the encoded element; equal elements count once."""

    def add(self, value: Any) -> None:
        self.store.put(self._at(self.codec.encode(value)), b"")

    def peek(self) -> Any:
        first = next(iter(self.store.scan_complex(self.group, self.key, b"")), None)
        return None if first is None else self.codec.decode(first[0])

    def poll(self) -> Any:
        value = self.peek()
        if value is not None:
            self.store.delete(self._at(self.codec.encode(value)))
        return value


class ReducingState(_Typed):
    def __init__(self, store: KvStore, name: str, reduce: Callable[[Any, Any], Any], codec: str | Codec = "pickle", key: bytes = b"") -> None:
        super().__init__(store, name, codec, key)
        self.reduce = reduce

    def add(self, value: Any) -> None:
        raw = self.store.get(self._at())
        self.store.put(self._at(), self.codec.encode(value if raw is None else self.reduce(self.codec.decode(raw), value)))

    def get(self) -> Any:
        raw = self.store.get(self._at())
        return None if raw is None else self.codec.decode(raw)


class AggregatingState(_Typed):
    """An accumulator, what adds a value to it, and what makes the result of it."""

    def __init__(self, store: KvStore, name: str, create: Callable[[], Any], add: Callable[[Any, Any], Any], result: Callable[[Any], Any], codec: str | Codec = "pickle", key: bytes = b"") -> None:
        super().__init__(store, name, codec, key)
        self.create, self.fold, self.result = create, add, result

    def add(self, value: Any) -> None:
        raw = self.store.get(self._at())
        self.store.put(self._at(), self.codec.encode(self.fold(self.create() if raw is None else self.codec.decode(raw), value)))

    def get(self) -> Any:
        raw = self.store.get(self._at())
        return None if raw is None else self.result(self.codec.decode(raw))


class Keyed:
    """Makes a state of one kind for each key: ``Keyed(ValueState, store, "n", "int64")(key)``."""

    def __init__(self, kind: type, store: KvStore, name: str, *args: Any, key_codec: str = "string") -> None:
        self.make, self.codec = lambda key: kind(store, name, *args, key=key), CODECS[key_codec]

    def __call__(self, key: Any) -> Any:
        return self.make(self.codec.encode(key))
