"""Driver-side outputs: metrics as JSON, the log of a run, check of a submission by an outside program."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

#: Order of the keys of a metrics file.
KEYS = ("experiment", "date", "status", "compared_to", "results", "config")

#: What happened in a run, in order: seconds since the epoch, kind (start, stage, result, file, error, end), text.
Event = tuple[float, str, str]


def _rounded(number: str) -> float:
    """A number as a metrics file has it: six places, or six digits if it is below that."""
    value = float(number)
    return float(format(value, ".6g" if 0 < abs(value) < 1e-6 else ".6f"))


def metrics_text(metrics: dict[str, Any]) -> str:
    """JSON with the known keys in their order, then any others; rounded; NaN and infinity are errors."""
    rank = {k: i for i, k in enumerate(KEYS)}
    rows = dict(sorted(metrics.items(), key=lambda kv: rank.get(kv[0], len(rank))))
    # Read back from exact JSON, where every number with a point comes by one place.
    rounded = json.loads(json.dumps(rows, allow_nan=False), parse_float=_rounded)
    return json.dumps(rounded, ensure_ascii=False, indent=2) + "\n"


def rendered(events: list[Event]) -> str:
    """The log of one run: a line an event, each with the seconds until the next; a stage that an error ended is marked FAIL."""
    began, ended = events[0][0], events[-1][0]
    failed = any(kind == "error" for _, kind, _ in events)
    lines = [f"# run of {time.strftime('%Y-%m-%dT%H:%M:%S', time.localtime(began))}: {'FAILED' if failed else 'SUCCESS'} after {ended - began:.1f} s"]
    for i, (at, kind, text) in enumerate(events[:-1]):
        if kind != "stage":
            lines.append(f"{kind:<7}{text}")
            continue
        until, why = next(((t, k) for t, k, _ in events[i + 1 :] if k in ("stage", "error", "end")), (ended, "end"))
        lines.append(f"{kind:<7}{text} [{'FAIL' if why == 'error' else f'{until - at:.1f} s'}]")
    return "\n".join(lines) + "\n\n"


@contextmanager
def run_log(path: Path, start: str) -> Iterator[Callable[[str, Any], None]]:
    """Gives a function (kind, text) to tell events with; what was told is appended to ``path`` at the end, also of a run that fails."""
    events: list[Event] = []

    def tell(kind: str, text: Any) -> None:
        events.append((time.time(), kind, str(text)))
        if kind == "stage":
            print(text, "...", flush=True)

    tell("start", start)
    try:
        yield tell
    except BaseException as e:
        tell("error", f"{type(e).__name__}: {e}")
        raise
    finally:
        tell("end", "")
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as f:
            f.write(rendered(events))


def outside_check(validator: Path, submission: Path) -> str:
    """Runs a validator program if there is one; a failure is an error."""
    if not validator.exists():
        return "skipped: no validator"
    done = subprocess.run([sys.executable, str(validator), str(submission)], check=False)
    if done.returncode:
        raise ValueError(f"the validator refused {submission}")
    return "passed"


def command_line(flag: str) -> str:
    return f"python -m odweave.cli {flag}"


def relative(path: Path, root: Path) -> str:
    return path.relative_to(root).as_posix() if path.is_relative_to(root) else str(path)
