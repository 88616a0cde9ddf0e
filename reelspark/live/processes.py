"""Running a tool to its end, with a time limit, with progress, or into a file that appears only when it is whole."""

from __future__ import annotations

import contextlib
import os
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterator
from queue import Empty, Queue

#: Seconds between looks at the clock and the cancel call, and those a told child has to end in.
POLL, GRACE = 0.2, 5.0


class ToolError(RuntimeError):
    """A tool couldn't be run, ran out of time, was cancelled, failed, or left nothing behind."""


def missing(argv: list[str]) -> str:
    return f"{argv[0]} not found"


def overdue(argv: list[str], action: str, seconds: float | None = None) -> str:
    """The limit is named only where the caller chose it."""
    return f"{argv[0]} timed out {'' if seconds is None else f'after {seconds:g}s '}{action}"


def failed(argv: list[str], action: str, stderr: str) -> str:
    return f"{argv[0]} failed {action}: {stderr.strip() or 'unknown error'}"


def run(argv: list[str], seconds: float, action: str) -> str:
    """What the tool prints. ``action`` tells in the error what it was doing."""
    try:
        done = subprocess.run(argv, capture_output=True, text=True, timeout=seconds)
    except FileNotFoundError:
        raise ToolError(missing(argv)) from None
    except subprocess.TimeoutExpired:
        raise ToolError(overdue(argv, action)) from None
    if done.returncode:
        raise ToolError(failed(argv, action, done.stderr))
    return done.stdout


def require_output(path: str, argv: list[str]) -> None:
    """A tool may end well without writing anything."""
    if not os.path.exists(path) or not os.path.getsize(path):
        raise ToolError(f"{argv[0]} produced no output at {path}")


@contextlib.contextmanager
def published(path: str) -> Iterator[str]:
    """A place beside ``path`` to write to; it takes that name if all goes well, else it is removed."""
    where, name = os.path.split(os.path.abspath(path))
    os.makedirs(where, exist_ok=True)
    fd, part = tempfile.mkstemp(prefix=f".{name}.", suffix=os.path.splitext(name)[1], dir=where)
    os.close(fd)
    try:
        yield part
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)
        raise


def _stop(child: subprocess.Popen) -> None:
    child.terminate()
    try:
        child.wait(GRACE)
    except subprocess.TimeoutExpired:
        child.kill()
        child.wait()


def _feed(stream, lines: Queue) -> None:
    """Lines, then None whatever happens, as the reader waits for it."""
    try:
        with stream:
            for line in stream:
                lines.put(line)
    finally:
        lines.put(None)


def watch(argv: list[str], seconds: float, action: str, on_block: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] | None = None) -> None:
    """Runs a tool that prints key=value lines, calling ``on_block`` at each ``progress`` line with the lines since the last.

    The child is stopped at the limit, when ``cancelled`` says so, and when a call raises.
    """
    until = time.monotonic() + seconds
    with tempfile.TemporaryFile("w+") as errors:
        try:
            child = subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=errors, text=True)
        except FileNotFoundError:
            raise ToolError(missing(argv)) from None
        lines: Queue = Queue()
        feeder = threading.Thread(target=_feed, args=(child.stdout, lines), daemon=True)
        feeder.start()
        try:
            block: dict[str, str] = {}
            ended = False
            while not ended:
                if cancelled and cancelled():
                    raise ToolError(f"{argv[0]} was cancelled {action}")
                left = until - time.monotonic()
                if left <= 0:
                    raise ToolError(overdue(argv, action, seconds))
                try:
                    line = lines.get(timeout=min(left, POLL))
                except Empty:
                    continue
                if line is None:
                    break
                key, given, value = line.strip().partition("=")
                if given and key == "progress":
                    if on_block:
                        on_block(block)
                    block, ended = {}, value == "end"
                elif given:
                    block[key] = value
            try:
                child.wait(max(0.0, until - time.monotonic()))
            except subprocess.TimeoutExpired:
                raise ToolError(overdue(argv, action, seconds)) from None
            if child.returncode:
                errors.seek(0)
                raise ToolError(failed(argv, action, errors.read()))
        finally:
            if child.poll() is None:
                _stop(child)
            feeder.join(GRACE)
