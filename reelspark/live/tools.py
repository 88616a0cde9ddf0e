"""What the tools on this machine can do. Each answer is asked for once in a process; a tool that can't be asked can't do it."""

from __future__ import annotations

import shutil
from functools import lru_cache

from .processes import ToolError, run

SECONDS = 10.0
#: A twentieth of a second of an empty picture, encoded or decoded to nowhere.
_NOTHING = "-f lavfi -i nullsrc=s=256x256:d=0.05 -frames:v 1".split()


def _works(argv: list[str]) -> bool:
    try:
        run(argv, SECONDS, "telling what it can do")
    except (ToolError, OSError):
        return False
    return True


@lru_cache
def present(tool: str = "ffmpeg") -> bool:
    return shutil.which(tool) is not None


@lru_cache
def hardware_decoding(tool: str = "ffmpeg") -> bool:
    """Whether a device opens; that it is listed says nothing."""
    return present(tool) and _works([tool, *"-v error -init_hw_device cuda".split(), *_NOTHING, "-f", "null", "-"])


def listed(name: str, listing: str) -> bool:
    """Whether the second column of a line is this encoder's name."""
    return any(line.split()[1:2] == [name] for line in listing.splitlines())


@lru_cache
def encoder_listed(name: str, tool: str = "ffmpeg") -> bool:
    if not present(tool):
        return False
    try:
        return listed(name, run([tool, "-hide_banner", "-encoders"], SECONDS, "listing its encoders"))
    except (ToolError, OSError):
        return False


@lru_cache
def encoder_usable(name: str, tool: str = "ffmpeg") -> bool:
    """Whether the encoder takes a frame here."""
    return encoder_listed(name, tool) and _works([tool, *"-v error".split(), *_NOTHING, *f"-pix_fmt yuv420p -c:v {name} -f null -".split()])


@lru_cache
def version(tool: str = "ffprobe") -> str:
    """Program and library, as in "ffprobe Lavf60.16.100"; empty where it can't be told."""
    try:
        out = run([tool, "-v", "error", "-show_library_versions", "-of", "csv=p=0"], SECONDS, "telling its version") if present(tool) else ""
    except (ToolError, OSError):
        out = ""
    ident = [c for line in out.splitlines() for c in line.split(",") if c.startswith("Lavf")]
    return f"{tool} {ident[0]}" if ident else ""
