"""python -m tersely RULES < text > text: apply rule files; exit 2 where a rule was rejected, 1 where there are none."""

from __future__ import annotations

import sys
from pathlib import Path

from tersely.operators.rules import compiled, fold, load_file

SUFFIXES = (".yaml", ".yml", ".json")


def main(argv: list[str]) -> int:
    if len(argv) != 1 or argv[0] in ("-h", "--help"):
        print(__doc__, file=sys.stderr)
        return 0 if argv[:1] in (["-h"], ["--help"]) else 1
    path = Path(argv[0])
    files = sorted(p for p in path.iterdir() if p.suffix in SUFFIXES) if path.is_dir() else [path] if path.is_file() else []
    if not files:
        print(f"no rule files at {path}", file=sys.stderr)
        return 1
    text, rejected = sys.stdin.read(), []
    for file in files:
        text, _, gone = fold(text, [(r, compiled(r)) for r in load_file(file)])
        rejected += [f"{file.name}: {r}" for r in gone]
    sys.stdout.write(text)
    for r in rejected:
        print(f"rejected {r}", file=sys.stderr)
    return 2 if rejected else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
