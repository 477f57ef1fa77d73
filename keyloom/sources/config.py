"""Settings: sizes, what CONFIG GET shows, what CONFIG SET may change, directive files."""

from __future__ import annotations

from collections.abc import Mapping

#: Parameters as CONFIG GET shows them, with their defaults.
DEFAULTS = {
    "bind": ":6379",
    "port": "6379",
    "maxclients": "10000",
    "timeout": "0",
    "tcp-keepalive": "300",
    "dir": "./data",
    "appendonly": "yes",
    "appendfsync": "everysec",
    "save": "900 1 300 10 60 10000",
    "requirepass": "",
    "proto-max-bulk-len": "536870912",
    "databases": "1",
    "storage-engine": "memory",
    "wal-segment-size": "67108864",
    "activeexpire": "yes",
    "loglevel": "info",
    "maxmemory": "0",
    "maxmemory-policy": "noeviction",
    "appendfilename": "wal",
    "dbfilename": "dump.rfs",
    "list-max-listpack-size": "128",
}
CHANGEABLE = ("appendfsync", "maxclients", "requirepass", "proto-max-bulk-len", "activeexpire", "loglevel")
LEVELS = ("debug", "info", "warn", "error")
POLICIES = {"always": "always", "everysec": "everysec", "": "everysec", "no": "no", "never": "no"}
UNITS = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 10**3, "m": 10**6, "g": 10**9}
YES = ("yes", "y", "true", "1", "on")
#: Directives of a file that CONFIG GET does not show, and those with another name there.
FILE_ONLY = ("engine-addr", "metrics-addr", "logformat")


class Unchangeable(ValueError):
    """A setting that cannot take this value."""


def size(text: str) -> int:
    """Bytes of a size like 64mb; kb, mb and gb count in 1024, k, m and g in 1000."""
    low = text.strip().lower()
    unit = next((u for u in UNITS if low.endswith(u)), "")
    digits = low.removesuffix(unit).strip()
    sign = digits[:1] in ("+", "-")
    if not (digits.isascii() and digits[sign:].isdigit()):
        raise ValueError(f'not a byte size: "{digits}"')
    if int(digits) < 0:
        raise ValueError("byte size must not be negative")
    return int(digits) * UNITS.get(unit, 1)


def changed(name: str, value: str) -> str:
    """The value that a running server would show after CONFIG SET."""
    name = name.lower()
    if name not in DEFAULTS:
        raise Unchangeable(f'unknown parameter "{name}"')
    if name not in CHANGEABLE:
        raise Unchangeable(f"parameter is not modifiable at runtime: {name}")
    if name == "maxclients" and not (value.isascii() and value.isdigit() and int(value) > 0):
        raise Unchangeable("maxclients must be a positive integer")
    if name == "loglevel" and value not in LEVELS:
        raise Unchangeable("loglevel must be debug, info, warn or error")
    if name == "appendfsync" and value not in POLICIES:
        raise Unchangeable(f'wal: unknown sync policy "{value}" (want always, everysec or no)')
    if name == "proto-max-bulk-len":
        try:
            size(value)
        except ValueError as problem:
            raise Unchangeable(str(problem)) from None
    return value


def directives(text: str) -> dict[str, str]:
    """Settings of a file of ``name value`` lines over the defaults; ``save`` lines add up.

    Blank lines and those that begin with # are skipped; a ``save`` without values turns
    snapshots off.  An unknown name or a wrong value is an error that names its line.
    """
    out, saves = dict(DEFAULTS), None
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        name, value = words[0].lower(), words[1] if len(words) > 1 else ""
        try:
            if name == "save":
                saves = saves or []
                if len(words) == 3:
                    saves.append(f"{int(words[1])} {int(words[2])}")
            elif name in ("maxclients", "timeout", "tcp-keepalive"):
                out[name] = str(int(value))
            elif name in ("proto-max-bulk-len", "wal-segment-size"):
                out[name] = str(size(value))
            elif name in ("appendonly", "activeexpire"):
                out[name] = "yes" if value.lower() in YES else "no"
            elif name in ("bind", "addr"):
                out |= {"bind": value, "port": value.rpartition(":")[2]}
            elif name == "port":
                out |= {"bind": f":{value}", "port": value}
            elif name == "databases" and value != "1":
                raise ValueError("this server implements a single database")
            elif name == "storage-engine" and value not in ("memory", "lsm"):
                raise ValueError("storage-engine must be memory or lsm")
            elif name == "appendfsync":
                out[name] = POLICIES[changed(name, value)]
            elif name in ("dir", "requirepass", "loglevel", "databases", "storage-engine", *FILE_ONLY):
                out[name] = value
            else:
                raise ValueError(f'unknown directive "{name}"')
        except ValueError as problem:
            raise ValueError(f"line {number}: {problem}") from None
    if saves is not None:
        out["save"] = " ".join(saves)
    return out


def settings(text: str = "", environment: Mapping[str, str] | None = None, prefix: str = "KEYLOOM_", **given: str) -> dict[str, str]:
    """File, then environment (``PREFIX_MAXCLIENTS`` for maxclients), then arguments; the last one named wins."""
    lines = [text]
    for name, value in sorted((environment or {}).items()):
        if name.startswith(prefix):
            lines.append(f"{name.removeprefix(prefix).lower().replace('_', '-')} {value}")
    lines += [f"{name.replace('_', '-')} {value}" for name, value in given.items()]
    return directives("\n".join(lines))
