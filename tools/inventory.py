"""Print SURVEY §2 inventory ids -> registered queries that exercise them."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrane.registry import load_all  # noqa: E402

ALL = ("S1-S28 K1-K11 F1-F19 J1-J8 A1-A10 W1-W6 U1-U6 X1-X18 G1-G16 P1-P15 T1").split()


def expand(tok):
    m = re.fullmatch(r"([A-Z])(\d+)-[A-Z](\d+)", tok)
    return [f"{m.group(1)}{i}" for i in range(int(m.group(2)), int(m.group(3)) + 1)] if m else [tok]


ids = [i for t in ALL for i in expand(t)]
reg = load_all()
cover = {i: [] for i in ids}
for name, e in reg.items():
    for i in e.ids:
        cover.setdefault(i, []).append(name + ("" if e.sql else " (rows)"))
for i in ids:
    print(f"{i}\t{', '.join(sorted(cover[i])) or '-'}")
