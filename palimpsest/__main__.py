"""python -m palimpsest [--json] [--colour] BEFORE AFTER: the difference of two files, as text or JSON.

With seven paths, as version control calls an external diff (path old-file old-hex old-mode new-file new-hex new-mode), the second and fifth are compared.
"""

from __future__ import annotations

import sys
from pathlib import Path

from palimpsest.functions.languages import EXTENSION_LANGUAGE
from palimpsest.operators.matching import Config
from palimpsest.operators.ranges import diff_pair


def language_of(path: str) -> str | None:
    name = path
    while name.endswith(".test"):
        name = name.removesuffix(".test")
    return EXTENSION_LANGUAGE.get(Path(name).suffix.lower().lstrip("."))


def main(args: list[str]) -> int:
    paths = [a for a in args if not a.startswith("--")]
    if len(paths) == 7:
        named, paths = paths[0], [paths[1], paths[4]]
    elif len(paths) == 2:
        named = paths[1]
    else:
        print(__doc__, file=sys.stderr)
        return 2
    before, after = (Path(p).read_text() if p != "/dev/null" else "" for p in paths)
    config = Config(match_imports="--match-imports" in args, match_flow_control="--match-flow-control" in args, bottom_up="--bottom-up" in args, moved_subtrees="--no-moved-subtrees" not in args, exact="--fast" not in args)
    done = diff_pair(before, after, language_of(named), config, "--colour" in args)
    print(done["json"] if "--json" in args else done["report"], end="" if "--json" not in args else "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
