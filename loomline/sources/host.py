"""What a recording process knows of its host and project."""

from __future__ import annotations

import functools
import os
import platform
import shutil
import subprocess
import time
from collections.abc import Callable
from datetime import UTC, datetime

from loomline.functions.canonical import jsonable

SNAPSHOT = "ts string, hostname string, os string, cpu_count int, memory_total_bytes long, memory_available_bytes long, disk_total_bytes long, disk_free_bytes long, project string"


def _memory() -> dict[str, int]:
    try:
        with open("/proc/meminfo") as f:
            found = dict(line.split(":", 1) for line in f)
        return {k: int(found[n].split()[0]) * 1024 for k, n in (("memory_total_bytes", "MemTotal"), ("memory_available_bytes", "MemAvailable"))}
    except (OSError, KeyError, ValueError, IndexError):
        return {"memory_total_bytes": None, "memory_available_bytes": None}


def project(env: dict[str, str] | None = None, folder: str = ".", variable: str = "LOOMLINE_PROJECT") -> str:
    """The project's name: of the environment, else of the origin of the folder's repository, else of the folder."""
    named = (os.environ if env is None else env).get(variable, "").strip()
    if named:
        return named
    try:
        url = subprocess.run(["git", "-C", folder, "config", "--get", "remote.origin.url"], capture_output=True, text=True, timeout=5, check=False).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        url = ""
    stem = url.rstrip("/").replace(":", "/").rpartition("/")[2].removesuffix(".git")
    return stem or os.path.basename(os.path.abspath(folder))


def snapshot(folder: str = ".") -> dict:
    """A row of SNAPSHOT for this host, now."""
    disk = shutil.disk_usage(folder)
    return {"ts": datetime.now(UTC).isoformat(), "hostname": platform.node(), "os": platform.system(), "cpu_count": os.cpu_count(), **_memory(), "disk_total_bytes": disk.total, "disk_free_bytes": disk.free, "project": project(folder=folder)}


def observe(record: Callable[[dict], None], name: str | None = None) -> Callable:
    """Decorate a function so that each call is recorded as a tool message: arguments, result or error, duration in ms.

    What record raises is not the caller's concern; what the function raises is.
    """

    def around(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            began, told = time.perf_counter(), {"role": "tool", "name": name or f.__name__, "arguments": jsonable({"args": args, **kwargs} if args else kwargs)}
            try:
                out = f(*args, **kwargs)
                told |= {"response": jsonable(out), "error": None}
                return out
            except BaseException as e:
                told |= {"response": None, "error": f"{type(e).__name__}: {e}"}
                raise
            finally:
                told["duration_ms"] = (time.perf_counter() - began) * 1000
                try:
                    record(told)
                except Exception:  # noqa: BLE001 - recording must not break what it records
                    pass

        return run

    return around
