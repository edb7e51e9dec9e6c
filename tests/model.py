"""A row-by-row model of the walk, used only to check the set-based jobs on small random data."""

import hashlib
from collections import defaultdict


def bucket(text):
    return hashlib.md5(text.encode()).hexdigest()[:3]


def walk_order(rows):
    """The pinned order of rows inside a hash; between hashes the order does not matter."""
    return sorted(rows, key=lambda r: (r["snapshot"], bucket(r["file"]), r["file"]))


class Blobs:
    """Blobs per hash in search order, with links."""

    def __init__(self, manifest, max_links, min_bytes):
        self.max_links, self.min_bytes = max_links, min_bytes
        seen = {}
        for r in manifest:
            b = seen.setdefault((r["hash"], r["blob_id"]), {"links": 0, "newest": "", "oldest": "~"})
            b["links"] += 1
            b["size"] = r["size"]
            b["newest"] = max(b["newest"], r["snapshot"])
            b["oldest"] = min(b["oldest"], r["snapshot"])
        self.by_hash = defaultdict(list)
        order = lambda i: (i[1]["newest"], i[1]["oldest"], bucket(i[0][1]), i[0][1])
        for (h, blob), b in sorted(seen.items(), key=order, reverse=True):
            self.by_hash[h].append([blob, b["links"], b["size"]])
        self.new = defaultdict(int)

    def place(self, row, run):
        """(action, blob) for a row that is stored."""
        known = self.by_hash[row["hash"]]
        if known and row["size"] >= self.min_bytes:
            for blob in known:
                if blob[1] < self.max_links and blob[2] >= self.min_bytes:
                    blob[1] += 1
                    return "dup_link", blob[0]
        action = "dup_copy" if known else "import"
        if row["size"] < self.min_bytes:
            blob = f"{run}#{row['hash']}@{row['snapshot']}/{row['file']}"
        else:
            blob = f"{run}#{row['hash']}#{self.new[row['hash']]}"
            self.new[row["hash"]] += 1
        known.append([blob, 1, row["size"]])
        return action, blob


    def follow(self, row, wanted):
        """Link to the wanted blob if it has room."""
        for blob in self.by_hash[row["hash"]]:
            if blob[0] == wanted and row["size"] >= self.min_bytes and blob[2] >= self.min_bytes and blob[1] < self.max_links:
                blob[1] += 1
                return "dup_link", wanted
        return None


def signature(r):
    return r["source"], r["size"], r["mtime_ns"]


def newest(manifest):
    found = {}
    for r in sorted(manifest, key=lambda r: r["hash"], reverse=True):
        at = found.get(signature(r))
        if at is None or r["snapshot"] >= at[0]:
            found[signature(r)] = (r["snapshot"], r["hash"])
    return {k: v[1] for k, v in found.items()}


def newest_blobs(manifest):
    """Blob of the newest record per signature: smallest hash there, then the last blob by name."""
    found = {}
    for r in sorted(manifest, key=lambda r: (r["hash"], [-ord(c) for c in r["blob_id"]]), reverse=True):
        at = found.get(signature(r))
        if at is None or r["snapshot"] >= at[0]:
            found[signature(r)] = (r["snapshot"], r["blob_id"])
    return {k: v[1] for k, v in found.items()}


def settle(kept, blobs, run, wanted):
    """Rows that follow their record first, then all others; (row, outcome)."""
    rest = []
    for r in walk_order(kept):
        held = blobs.follow(r, wanted[signature(r)]) if signature(r) in wanted else None
        if held:
            yield r, held
        else:
            rest.append(r)
    for r in rest:
        yield r, blobs.place(r, run)


def take_snapshot(files, manifest, content, run, incremental, always_hash, max_links, min_bytes, affinity=False):
    prior = newest(manifest)
    blobs = Blobs(manifest, max_links, min_bytes)
    out, kept, read = {}, [], set()
    for f in files:
        old = prior.get(signature(f))
        if old and not always_hash:
            h = old
        else:
            h = content[f["source"]]
            read.add(f["source"])
        if old and old != h:
            out[f["file"]] = ("conflict", None)
        elif old and incremental:
            out[f["file"]] = ("skip", None)
        else:
            kept.append({**f, "hash": h})
    for r, outcome in settle(kept, blobs, run, newest_blobs(manifest) if affinity else {}):
        out[r["file"]] = outcome
    return out, read


def clone(source, target, run, incremental, max_links, min_bytes, affinity=False):
    known = newest(target)
    blobs = Blobs(target, max_links, min_bytes)
    out, kept = {}, []
    for r in sorted(source, key=lambda r: (r["snapshot"], r["file"], r["hash"])):
        key = (r["snapshot"], r["file"])
        old = known.get(signature(r))
        if old and old != r["hash"]:
            out[key] = ("conflict", None)
        elif old and incremental:
            out[key] = ("skip", None)
        else:
            known[signature(r)] = r["hash"]
            kept.append(r)
    for r, outcome in settle(kept, blobs, run, newest_blobs(target) if affinity else {}):
        out[(r["snapshot"], r["file"])] = outcome
    return out


def distill(manifest, targets):
    attached = {r["snapshot"] for r in manifest}
    left = list(manifest)
    for t in targets:
        attached.discard(t)
        there = {r["hash"] for r in left if r["snapshot"] in attached}
        left = [r for r in left if r["snapshot"] != t or r["hash"] not in there]
    return {(r["snapshot"], r["file"]) for r in left}
