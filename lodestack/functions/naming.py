"""Names of indexes and providers, and the driver's small helpers."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IndexIdentity:
    provider: str
    model: str
    dims: int

    @property
    def file_name(self) -> str:
        return f"index.{self.provider}.{self.model.replace('/', '-')}.{self.dims}.db"

    @property
    def index_name(self) -> str:
        return self.file_name.removesuffix(".db")

    @property
    def provider_id(self) -> str:
        return f"{self.provider}/{self.model}"

    def __str__(self) -> str:
        return f"{self.provider}/{self.model} ({self.dims}d)"


def parse_file_name(name: str) -> IndexIdentity | None:
    """The identity in a name: the first part is the provider, the last the dimensions, all between the model."""
    found = re.fullmatch(r"index\.([^.]+)\.(.+)\.(\d+)\.db", name)
    return IndexIdentity(found[1], found[2], int(found[3])) if found else None


def file_names(provider: Column, model: Column, dims: Column) -> Column:
    """File names of identities, for columns."""
    return F.concat(F.lit("index."), provider, F.lit("."), F.replace(model, F.lit("/"), F.lit("-")), F.lit("."), dims, F.lit(".db"))


def parsed_names(name: Column) -> Column:
    """The same for a column, as a struct; null where a name isn't one."""
    pattern = r"^index\.([^.]+)\.(.+)\.([0-9]+)\.db$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    made = F.struct(part(1).alias("provider"), part(2).alias("model"), part(3).try_cast("long").alias("dims"))
    return F.when(name.rlike(pattern), made)


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path.startswith("~/") else path


def run_id() -> str:
    """16 hex digits of the clock and 8 of the process."""
    return f"{time.time_ns():016x}{os.getpid():08x}"


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def peak_memory() -> int | None:
    """The most memory that this process has held, in bytes, where the system tells."""
    try:
        with open("/proc/self/status") as status:
            found = re.search(r"VmHWM:\s+(\d+) kB", status.read())
    except OSError:
        return None
    return int(found[1]) * 1024 if found else None
