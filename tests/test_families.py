"""Families of nested containers against one reading from first to last."""

import io
import random
import zipfile
from email.message import EmailMessage

import pytest

from lexfold.sources.families import Limits, expand, kind_of
from lexfold.session import importable


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members:
            z.writestr(n, d)
    return b.getvalue()


def mail(text, attachments):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "s", "a@x.com", "b@x.com"
    m.set_content(text)
    for n, d in attachments:
        m.add_attachment(d, maintype="application", subtype="octet-stream", filename=n)
    return m.as_bytes()


def made(r, depth=0):
    """name and bytes of a random tree of containers."""
    kind = r.choice(["txt", "txt", "bin", "zip", "eml"] if depth < 4 else ["txt"])
    name = f"{'../' if r.random() < 0.08 else ''}f{r.randrange(1000)}.{kind}"
    if kind == "txt":
        return name, bytes(r.choice(b"abc ") for _ in range(r.randrange(60)))
    if kind == "bin":
        return name, b"\x00"
    if r.random() < 0.1:
        return name, b"broken" if kind == "zip" else mail("x", [])
    members = [made(r, depth + 1) for _ in range(r.randrange(5))]
    return name, zipped(members) if kind == "zip" else mail(f"body {r.randrange(99)}", [(n.replace("../", ""), d) for n, d in members])


def loop(control, name, data, limits):
    """(control, parent, name, notes?) in order, by recursion."""
    out = []

    def unzip(data, depth, state, name):
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except Exception:
            state["notes"] += 1
            state["closed"] |= depth == 1
            return
        for i in z.infolist():
            if state["full"]:
                return
            if ".." in i.filename:
                state["notes"] += 1
                continue
            d = z.read(i)
            if len(d) > limits.entry_bytes:
                state["notes"] += 1
                continue
            inner = kind_of(i.filename) == "zip" and depth < limits.depth
            if (not inner and len(state["found"]) >= limits.entries) or state["bytes"] + len(d) > limits.total_bytes:
                state["full"] = True
                state["notes"] += 1
                return
            state["bytes"] += len(d)
            if inner:
                unzip(d, depth + 1, state, i.filename)
            else:
                state["found"].append((i.filename, d))

    def visit(control, parent, name, data, inside):
        kind = kind_of(name)
        at = len(out)
        out.append(None)
        status = "ok" if kind != "file" or name.endswith(".txt") else "unsupported"
        if kind == "zip" and inside:
            status = "unsupported"  # too deep to be opened
        elif kind == "zip":
            state = {"found": [], "bytes": 0, "full": False, "notes": 0, "closed": False}
            unzip(data, 1, state, name)
            status = "error" if state["closed"] else "partial" if state["notes"] else "ok"
            for k, (n, d) in enumerate(state["found"], 1):
                visit(f"{control} .{k:04d}", control, n, d, True)
        elif kind == "mail":
            import email
            import email.policy

            for k, a in enumerate(email.message_from_bytes(data, policy=email.policy.default).iter_attachments(), 1):
                visit(f"{control} .{k:04d}", control, a.get_filename(), a.get_payload(decode=True), False)
        out[at] = (control, parent, name, status)

    visit(control, None, name, data, False)
    return out


@pytest.mark.parametrize("seed, limits, parts", [(1, Limits(), 1), (2, Limits(), 5), (3, Limits(depth=3, entries=3), 3), (4, Limits(entries=2), 2), (5, Limits(entry_bytes=900, total_bytes=1500), 3)])
def test_equal_to_one_reading(spark, seed, limits, parts):
    r = random.Random(seed)
    files = [(f"C{i:03d}", *made(r)) for i in range(50)]
    got = expand(importable(spark).createDataFrame(files, "control string, name string, raw binary").repartition(parts), limits).collect()
    want = {x[0]: x for c, n, d in files for x in loop(c, n, d, limits)}
    assert {g.control: (g.control, g.parent, g.name, g.status) for g in got} == want and len(want) > 60
    assert all(g.family_id == g.control.split(" ")[0] and (g.note is None or len(g.note) <= 500) for g in got)
    assert all((g.note is not None) == (g.status in ("partial", "error")) for g in got if g.file_type in ("zip",))


def test_mail_in_archive_in_mail(spark):
    inner = mail("inside", [("a.txt", b"alpha")])
    outer = mail("outside", [("pack.zip", zipped([("deep.zip", zipped([("m.eml", inner)])), ("/etc/x", b"no"), ("b.txt", b"beta")])), ("c.txt", b"gamma")])
    got = {g.control: (g.file_type, g.status, g.text) for g in expand(importable(spark).createDataFrame([("M1", "m.eml", outer), ("M2", "x.txt", None)], "control string, name string, raw binary")).collect()}
    assert got == {
        "M1": ("email", "ok", "outside"), "M1 .0001": ("zip", "partial", None), "M1 .0002": ("txt", "ok", "gamma"),
        "M1 .0001 .0001": ("email", "ok", "inside"), "M1 .0001 .0002": ("txt", "ok", "beta"), "M1 .0001 .0001 .0001": ("txt", "ok", "alpha"), "M2": ("txt", "ok", ""),
    }


def test_nothing(spark):
    assert expand(importable(spark).createDataFrame([], "control string, name string, raw binary")).collect() == []
