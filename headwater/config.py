"""Settings, names of metrics and schemas."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

#: The names under which measurements are reported.
COMPLETE_LATENCY, MISS_QOS, LATENCY_STAT, EXECUTE, DURATION = "complete-latency", "miss-qos", "latency-stat", "execute", "duration"
SEND_QUEUE, RECV_QUEUE, EMIT, SERIALIZED = "send-queue", "recv-queue", "emit", "serialized"
#: Older reports use these names for the queues.
OLD_NAMES = {"sendqueue": SEND_QUEUE, "receive": RECV_QUEUE}


def _dotted(values: Mapping[str, Any], before: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in values.items():
        out |= _dotted(v, f"{before}{k}.") if isinstance(v, Mapping) else {f"{before}{k}": v}
    return out


class Settings(Mapping[str, Any]):
    """A flat mapping with typed getters: a value of another kind, or none, gives the default; need_...() raise instead."""

    def __init__(self, values: Mapping[str, Any] | None = None, **more: Any):
        self._values = {**(values or {}), **more}

    def __getitem__(self, key: str) -> Any:
        return self._values[key]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def _number(self, key: str) -> float | None:
        value = self._values.get(key)
        return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None

    def integer(self, key: str, default: int) -> int:
        value = self._number(key)
        return default if value is None else int(value)

    def number(self, key: str, default: float) -> float:
        value = self._number(key)
        return default if value is None else float(value)

    def flag(self, key: str, default: bool) -> bool:
        value = self._values.get(key)
        return value if isinstance(value, bool) else default

    def text(self, key: str, default: str) -> str:
        value = self._values.get(key)
        return value if isinstance(value, str) else default

    def need_integer(self, key: str) -> int:
        return int(self.need_number(key))

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings of a JSON file, or of a YAML file if PyYAML is there; nested mappings become dotted keys."""
        with open(path, encoding="utf-8") as f:
            content = f.read()
        if path.endswith(".json"):
            values = json.loads(content)
        else:
            import yaml

            values = yaml.safe_load(content)
        if not isinstance(values or {}, Mapping):
            raise ValueError(f"{path} holds no mapping")
        return cls(_dotted(values or {}))

    def need_number(self, key: str) -> float:
        value = self._number(key)
        if value is None:
            raise KeyError(f"{key} must be a number")
        return float(value)

    def need_text(self, key: str) -> str:
        if not isinstance(value := self._values.get(key), str):
            raise KeyError(f"{key} must be a text")
        return value


@dataclass(frozen=True)
class Scheduling:
    """Defaults of the optimiser; fixed values."""

    qos_ms: float = 5000.0
    history: int = 1
    ignore: int = 0
    sample_rate: float = 1.0
    measure_rate: float = 0.05
    per_worker: int = 8
    allowed: int = -1
    interval_s: int = 30
    #: How often a record passes a source's send queue.
    send_factor: float = 2.0
    latency_axis: tuple[float, ...] = ()

    @staticmethod
    def of(settings: Settings) -> Scheduling:
        d = Scheduling()
        return Scheduling(
            qos_ms=settings.number("qos.ms", d.qos_ms), history=settings.integer("history.size", d.history), ignore=settings.integer("history.ignore", d.ignore),
            sample_rate=settings.number("sample.rate", d.sample_rate), measure_rate=settings.number("measure.rate", d.measure_rate), per_worker=settings.integer("executors.per.worker", d.per_worker),
            allowed=settings.integer("executors.allowed", d.allowed), interval_s=settings.integer("interval.s", d.interval_s), send_factor=settings.number("send.factor", d.send_factor),
        )


@dataclass(frozen=True)
class Matching:
    """Parameters of image matching; fixed values."""

    contrast: float = 0.04
    edge: float = 10.0
    sigma: float = 2.0
    reprojection: float = 1.0
    least_matches: int = 8
    ratio: float = 0.8
    pool: int = 5
    box_share: float = 0.9
    window_step: float = 0.25
    window_share: float = 0.33
    margin: float = 0.1


#: Fixed value: template updates remembered against repeats.
REMEMBERED = 4096

RECT = StructType().add("x", IntegerType()).add("y", IntegerType()).add("width", IntegerType()).add("height", IntegerType())
IMAGE = StructType().add("rows", IntegerType()).add("cols", IntegerType()).add("type", IntegerType()).add("data", BinaryType())
PATCH = StructType().add("frame", LongType()).add("roi", RECT)
POINT = StructType().add("x", DoubleType()).add("y", DoubleType())
TEMPLATE_UPDATE = StructType().add("host", PATCH).add("rect", RECT).add("parent", PATCH).add("logo", IntegerType())
STREAM_FRAME = StructType().add("frame", LongType()).add("image", IMAGE)
MEASUREMENT = StructType().add("component", StringType()).add("task", LongType()).add("millis", LongType()).add("data", StringType())
MOMENTS = StructType().add("cnt", LongType()).add("total", DoubleType()).add("sumsq", DoubleType())
NODE = StructType().add("comp", StringType()).add("lam", DoubleType()).add("mu", DoubleType()).add("ratio", DoubleType())
PLAN = StructType().add("tasks", ArrayType(ArrayType(IntegerType()))).add("cost", DoubleType()).add("matching", ArrayType(ArrayType(IntegerType())))
SIGNED = StructType().add("sentence", StringType()).add("is_add", BooleanType())


@dataclass
class Registry:
    """Named callables, the plug-ins of a scheduler."""

    kind: str
    known: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str):
        def put(f):
            if name in self.known:
                raise ValueError(f"{self.kind} {name} exists")
            self.known[name] = f
            return f

        return put

    def get(self, name: str) -> Any:
        if name not in self.known:
            raise KeyError(f"no {self.kind} named {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name]
