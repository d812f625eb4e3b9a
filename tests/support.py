"""Small catalogs on disk and engines over them."""

import json

from veltra.engine import Engine


def cell(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return "true" if v else "false"
    return '"' + v.replace('"', '""') + '"' if isinstance(v, str) else repr(v)


def write_catalog(folder, tables):
    """``tables``: name to (columns as "name TYPE" with ? for nullable, rows)."""
    spec = []
    for name, (columns, rows) in tables.items():
        cols = []
        for c in columns:
            n, t = c.split()
            cols.append({"name": n, "type": t.rstrip("?"), "nullable": t.endswith("?")})
        text = ",".join(c["name"] for c in cols) + "\n" + "".join(",".join(map(cell, r)) + "\n" for r in rows)
        (folder / f"{name}.csv").write_bytes(text.encode())
        spec.append({"name": name, "path": f"{name}.csv", "columns": cols})
    path = folder / "catalog.json"
    path.write_text(json.dumps({"tables": spec}))
    return path


def engine_of(spark, folder, tables, **limits):
    e = Engine(spark, **limits)
    e.load_catalog(write_catalog(folder, tables))
    return e


ITEMS = ["id INT64", "n INT64?", "d DOUBLE?", "b BOOL?", "s STRING?"]
ONE = {"items": (ITEMS, [[1, 2, 1.5, True, "x"]])}
