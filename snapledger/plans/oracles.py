"""The same results in plain SQL, written independently of the Spark jobs."""

from __future__ import annotations

ROW = "snapshot, source, size, mtime_ns, hash, file"
SIG = "source, size, mtime_ns"

DOC_BASE = """
  concat('/', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as source,
  cast(octet_length(encode(text)) as bigint) as size,
  cast((1704067200 + doc_id * 60) * 1000000000 as bigint) as mtime_ns,
  concat('#', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as file"""

DOCS = f"""docs as (
  select concat('s', cast(doc_id % 4 as varchar)) as snapshot, {DOC_BASE},
    sha256(text) as hash, sha256(text) as blob_id, doc_id
  from documents)"""

PRIOR = """prior as (
  select concat('s', cast(doc_id % 4 as varchar)) as snapshot,
    concat('/', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as source,
    cast(octet_length(encode(text)) + case when doc_id % 3 = 0 then 4 else 0 end as bigint) as size,
    cast((1704067200 + doc_id * 60 - case when doc_id % 3 = 0 or doc_id % 7 = 0 then 1 else 0 end)
      * 1000000000 as bigint) as mtime_ns,
    case when doc_id % 3 = 0 or doc_id % 11 = 0 then sha256(text || '-old') else sha256(text) end as hash,
    concat('#', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as file,
    concat(case when doc_id % 3 = 0 or doc_id % 11 = 0 then sha256(text || '-old') else sha256(text) end,
      '-', cast(doc_id % 2 as varchar)) as blob_id
  from documents)"""

NEW_DOCS = f"new_docs as (select 's9' as snapshot, {DOC_BASE}, sha256(text) as hash from documents)"

EVENTS = """ev as (
  select strftime(ts, '%Y-%m-%d') as snapshot,
    concat('/u/', cast(user_id as varchar), '/', event_type) as source,
    cast(octet_length(encode(props)) as bigint) as size, cast(0 as bigint) as mtime_ns,
    sha256(props) as hash, concat('f', cast(event_id as varchar)) as file, sha256(props) as blob_id
  from events)"""

TARGET = """tgt as (
  select concat('t', strftime(ts, '%Y-%m-%d')) as snapshot,
    concat(case when user_id % 2 = 0 then '/u/' else '/v/' end, cast(user_id as varchar), '/', event_type) as source,
    cast(octet_length(encode(props)) as bigint) as size, cast(0 as bigint) as mtime_ns,
    sha256(props) as hash, concat('t', cast(event_id as varchar)) as file, sha256(props) as blob_id
  from events)"""

FLAWED = f"""{EVENTS}, numbered_ev as (select *, cast(substr(file, 2) as bigint) as n from ev),
flawed_once as (
  select snapshot, case when n % 101 = 0 then '' else source end as source,
    case when n % 103 <> 0 then size end as size,
    case when n % 107 = 0 then -1 else mtime_ns end as mtime_ns,
    case when n % 109 = 0 then 'ERROR' when n % 113 <> 0 then hash end as hash, file
  from numbered_ev),
flawed as (select * from flawed_once union all
  select * from flawed_once where ends_with(source, '/purchase'))"""

HOLED = """holed as (
  select * replace (case when n % 127 <> 0 then snapshot end as snapshot), coalesce(regexp_matches(hash, '^[0-9a-f]{64}$'), false) as usable
  from (select *, cast(substr(file, 2) as bigint) as n from flawed))"""

URLS = "urls as (select '/' as root, regexp_replace(url, '^https?:/', '') as path, page_id from pages)"

DOC_INV = """doc_inv as (
  select snapshot, file, size, mtime_ns, min(doc_id) over (partition by hash) as inode
  from docs where doc_id % 37 <> 0)"""

MIXED_INV = "mixed as (select snapshot, file, doc_id // 5 as inode from docs where doc_id % 37 <> 0)"


def newest(manifest: str, name: str = "newest") -> str:
    return f"""{name} as (
  select {SIG}, hash as prior_hash, snapshot as prior_snapshot from (
    select *, row_number() over (partition by {SIG} order by snapshot desc, hash, file) as k
    from {manifest} where hash is not null and hash <> '') where k = 1)"""


def assign(kept: str, manifest: str, run: str, max_links: int = 65000, min_bytes: int = 0) -> str:
    """CTEs ending in ``decided``: kept rows with action and blob_id."""
    return f"""held as (
  select hash, blob_id, max(snapshot) as newest, min(snapshot) as oldest,
    case when max(size) >= {min_bytes} then greatest({max_links} - count(*), 0) else 0 end as spare
  from {manifest} group by hash, blob_id),
{decide(kept, run, max_links, min_bytes)}"""


def decide(kept: str, run: str, max_links: int = 65000, min_bytes: int = 0) -> str:
    """The CTEs of ``assign`` after ``held``, the blobs there are."""
    order = "newest desc, oldest desc, substr(md5(blob_id), 1, 3) desc, blob_id desc"
    return f"""slots as (
  select hash, blob_id, spare, coalesce(sum(spare) over (partition by hash order by {order}
    rows between unbounded preceding and 1 preceding), 0) as lo from held),
room as (select hash, sum(spare) as c from held group by hash),
numbered as (select *, row_number() over (
  partition by hash order by snapshot, substr(md5(file), 1, 3), file) as n from {kept}),
decided as (
  select d.*,
    case when r.c is null and n = 1 then 'import'
      when size < {min_bytes} or (n > coalesce(c, 0) and (n - coalesce(c, 0) - 1) % {max_links} = 0) then 'dup_copy'
      else 'dup_link' end as action,
    case when size < {min_bytes} then concat('{run}#', d.hash, '@', d.snapshot, '/', d.file)
      when n > coalesce(c, 0)
        then concat('{run}#', d.hash, '#', cast((n - coalesce(c, 0) - 1) // {max_links} as bigint))
      else s.blob_id end as blob_id
  from numbered d left join room r on d.hash = r.hash
  left join slots s on d.hash = s.hash and d.n > s.lo and d.n <= s.lo + s.spare)"""


def follow(kept: str, manifest: str, run: str, max_links: int) -> str:
    """CTEs ending in ``decided``: kept rows that have a ``prior_blob`` take that first."""
    return f"""held_before as (
  select hash, blob_id, max(snapshot) as newest, min(snapshot) as oldest, greatest({max_links} - count(*), 0) as spare
  from {manifest} group by hash, blob_id),
in_line as (select k.*, h.spare, row_number() over (
    partition by k.hash, prior_blob order by k.snapshot, substr(md5(file), 1, 3), file) as place
  from {kept} k left join held_before h on h.hash = k.hash and h.blob_id = k.prior_blob),
followed as (select * from in_line where place <= spare),
others as (select * exclude (spare, place, prior_blob) from in_line where spare is null or place > spare),
taken as (select hash, prior_blob as blob_id, count(*) as n from followed group by all),
held as (select hash, blob_id, newest, oldest, spare - coalesce(n, 0) as spare
  from held_before left join taken using (hash, blob_id)),
{decide('others', run, max_links)}"""


NEWEST_BLOB = f"""newest as (
  select {SIG}, hash as prior_hash, blob_id as prior_blob from (
    select *, row_number() over (partition by {SIG} order by snapshot desc, hash, blob_id desc) as k from prior)
  where k = 1)"""


def take_snapshot(incremental: bool, always_hash: bool, max_links: int = 65000, min_bytes: int = 0) -> str:
    content = "true" if always_hash else "prior_hash is null"
    skip = "true" if incremental else "false"
    return f"""{PRIOR}, {newest('prior')}, files as (
  select 's9' as snapshot, {DOC_BASE}, sha256(text) as content_hash from documents
  where doc_id % 29 <> 0 and doc_id % 31 <> 0 and lang <> 'fr'
    and not ends_with(concat('/', cast(doc_id as varchar), '.txt'), '77.txt')),
looked as (select f.*, prior_hash, {content.replace('prior_hash', 'p.prior_hash')} as hashed
  from files f left join newest p using ({SIG})),
judged as (select snapshot, {SIG}, file, prior_hash, hashed,
    case when hashed then content_hash else prior_hash end as hash from looked),
stated as (select *, case when hashed and prior_hash <> hash then 'conflict'
    when {skip} and prior_hash is not null then 'skip' end as state from judged),
kept as (select * from stated where state is null),
{assign('kept', 'prior', 's9', max_links, min_bytes)},
actions as (
  select {ROW}, blob_id, action, hashed from decided
  union all
  select {ROW}, null, state, hashed from stated where state is not null)"""


def clone(target: str, incremental: bool, suffix: str = "", max_links: int = 65000) -> str:
    later = "kept_hash is not null or k > 1" if incremental else "false"
    return f"""{newest(target)}, firsts as (
  select e.*, p.prior_hash as kept_hash,
    row_number() over (partition by {SIG} order by e.snapshot, file, hash) as k,
    first_value(hash) over (partition by {SIG} order by e.snapshot, file, hash) as first_hash
  from ev e left join newest p using ({SIG})),
stated as (select concat(snapshot, '{suffix}') as snapshot, {SIG}, hash, file,
    case when hash <> coalesce(kept_hash, first_hash) then 'conflict' when {later} then 'skip' end as state
  from firsts),
kept as (select * from stated where state is null),
{assign('kept', target, 'run', max_links)}
select {ROW}, action, blob_id from decided
union all
select {ROW}, state, null from stated where state is not null"""


def distill(rows: str, rank: str, last: str) -> str:
    return f"""ranked as (select *, {rank} as rnk from {rows}),
standing as (select *, max(rnk) over (partition by hash) as top from ranked)
select {ROW} from standing where {last}"""


TARGET_RANK = "case snapshot when 's1' then 1 when 's3' then 2 else 3 end"

FILE_TABLE = f"""linked as (select d.*, i.inode from docs d join doc_inv i using (snapshot, file)),
ranked as (select *, row_number() over (partition by inode order by snapshot, file) as k from linked),
counts as (select inode, {', '.join(f"count(*) filter (snapshot = 's{i}') as s{i}" for i in range(4))}
  from linked group by inode)"""

EVENT_REPS = f"""{EVENTS}, ranked as (
  select *, row_number() over (partition by cast(substr(file, 2) as bigint) // 3 order by snapshot, file) as k
  from ev),
reps as (select * from ranked where k = 1)"""

MIXED_LINKS = f"""{DOCS}, {MIXED_INV}, linked as (
  select d.*, i.inode from docs d left join mixed i using (snapshot, file)),
ranked as (select *, row_number() over (partition by inode order by snapshot, file) as k
  from linked where inode is not null),
reps as (select * from ranked where k = 1)"""

STORED = f"""stored as (select concat('s', cast(doc_id % 4 as varchar)) as snapshot,
    concat('#', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as file,
    case when doc_id % 17 = 0 then 'ERROR' when doc_id % 13 = 0 then sha256(text || 'x')
      else sha256(text) end as found_hash
  from documents)"""


def verify_report(rehash: bool) -> str:
    found = "coalesce(s.found_hash, 'ERROR')" if rehash else "r.hash"
    extra = (
        """union all select 'rehash_mismatch', snapshot, file, found, 'error' from known where found <> hash
union all select 'rehash_mismatch', snapshot, file, 'ERROR', 'error' from linked where inode is null"""
        if rehash
        else ""
    )
    return f"""{MIXED_LINKS}, {STORED},
known as (select r.*, {found} as found from reps r left join stored s using (snapshot, file)),
by_hash as (select {SIG}, found, min(struct_pack(s := snapshot, f := file)) as spot from known group by {SIG}, found),
anchored as (select *, first_value(found) over w as low, first_value(spot) over w as low_spot
  from by_hash window w as (partition by {SIG} order by found))
select 'unreadable_index' as check, snapshot, file, concat(snapshot, '/', file) as detail, 'error' as level
from linked where inode is null
{extra}
union all select 'hash_consistency', a.snapshot, a.file, k.found, 'error'
from ranked a join known k using (inode) where a.k > 1 and a.hash <> k.found
union all select 'signature_uniqueness', spot.s, spot.f, concat(low_spot.s, '/', low_spot.f), 'error'
from anchored where found <> low"""


STATES = """states as (
  select distinct strftime(ts, '%Y-%m-%d') as snapshot,
    case when day(ts) % 5 = 0 then 'in_progress' when day(ts) % 7 <> 0 then 'complete' end as state
  from events)"""


def chain(column: str) -> str:
    """All paths from the first component down to ``column`` itself."""
    parts = f"string_split(substr({column}, 2), '/')"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: '/' || array_to_string({parts}[1:i], '/'))"


def url_marks(test: str) -> str:
    steps = f"list_concat(['/'], {chain('path')})"
    return f"{URLS}, marked as (select *, list_filter({steps}, lambda a: {test})[1] as excluded_by from urls)"


URL_TEST = "ends_with(a, '.html') or ends_with(a, '#top') or ends_with(a, '.net')"

URL_INV = """url_inv as (select page_id, regexp_replace(url, '^https?:/', '') as path,
  case when ends_with(url, '#top') then 'symlink' when ends_with(url, '/') then 'directory'
    when ends_with(url, '.html') then 'regular' when contains(url, 'utm_source') then 'not_found'
    when contains(url, 'ref=x') then 'socket' else 'regular' end as type,
  cast(octet_length(encode(html)) as bigint) as size, page_id as mtime_ns from pages)"""

URL_ROOTS = f"""{URLS}, url_roots as (
  select page_id as ord, path as root from urls
  union all select page_id, path[1:len(path) - len(string_split(path, '/')[-1]) - 1] from urls),
roots as (select * from url_roots where root <> ''),
known as (select root, count(*) as times from roots group by root)"""

REPO = "'/spam-farm.example.org/en'"


def overlapping(component: bool) -> str:
    if component:
        covers = "a.root = '/' or starts_with(b.root, a.root || '/')"
        inside = f"root = {REPO} or starts_with(root, {REPO} || '/')"
        around = f"root = {REPO} or root = '/' or starts_with({REPO}, root || '/')"
    else:
        covers = "starts_with(b.root, a.root)"
        inside, around = f"starts_with(root, {REPO})", f"starts_with({REPO}, root)"
    return f"""with {URL_ROOTS}
select root, root as other, 'equal' as problem from known where times > 1
union all select b.root, min(a.root), 'part_of_root' from known a join known b
  on a.root <> b.root and ({covers}) group by b.root
union all select root, {REPO}, 'part_of_repository' from known where {inside}
union all select root, {REPO}, 'contains_repository' from known where {around}"""


SITES = """sites as (
  select concat(case when starts_with(url, 'https') then '/' else '#' end,
      regexp_extract(url, '^https?://([^/]+)', 1)) as root,
    regexp_replace(url, '^https?://[^/]+', '') as below, page_id from pages),
site_roots as (select root, min(page_id) as ord from sites group by root),
keyed as (select root, replace(root, '/', '#') as name,
    row_number() over (partition by replace(root, '/', '#') order by ord, root) as nth from site_roots)"""

TREE = f"""{DOCS}, tops as (select distinct snapshot, string_split(file, '/')[1] as top from docs),
dirs as (
  select snapshot, top as file from tops
  union select snapshot, top || '/spare' from tops
  union select distinct snapshot, concat(string_split(file, '/')[1], '/', string_split(file, '/')[2]) from docs),
left_files as (select * from docs where not contains(file, '/de/') and not starts_with(file, '#src3/'))"""

ACTION_TOTALS = """
select measure, count(*) filter (hit) as files, coalesce(sum(size) filter (hit), 0)::bigint as bytes from (
  select size, unnest([
    {'measure': 'hashed', 'hit': hashed},
    {'measure': 'copied', 'hit': action in ('import', 'dup_copy')},
    {'measure': 'linked', 'hit': action = 'dup_link'},
    {'measure': 'deleted', 'hit': action = 'delete'}], recursive := true) from acts)
group by measure"""

LOOKED = f"""{EVENTS}, {TARGET}, {newest('tgt')},
looked as (select e.*, prior_hash, prior_snapshot from ev e left join newest p using ({SIG}))"""

INTEGRITY_PROBLEM = """case when source is null or source = '' then 'source'
    when size is null or size < 0 then 'size' when mtime_ns is null or mtime_ns = -1 then 'mtime_ns'
    when hash is null or hash = '' or not regexp_matches(hash, '^[0-9a-f]{64}$') then 'hash'
    when file is null or file = '' then 'file' when snapshot is null or snapshot = '' then 'snapshot' end"""

SIZE_TEXT = "lpad(format('{:,}', size), 15, ' ')"
STAMP = "make_timestamp(mtime_ns // 1000)"

ORACLES: dict[str, str] = {
    "manifest_lookup": f"with {EVENTS} select {ROW} from ev where source = '/u/8/error' and size = 9",
    "repository_union": f"with {DOCS}, {EVENTS} select {ROW} from docs union all select {ROW} from ev",
    "append_manifest": f"""with {PRIOR}, {NEW_DOCS}, {assign('new_docs', 'prior', 's9')}
select {ROW}, blob_id from decided""",
    "manifest_delete": f"""with {EVENTS}
select {ROW} from ev where not (ends_with(source, '/error') and cast(substr(file, 2) as bigint) % 3 <> 0)""",
    "compact_roundtrip": f"with {DOCS} select {ROW} from docs",
    "invalid_snapshots": f"""with {STATES} select snapshot,
  case when state is null then 'manifest_missing' else 'unfinished' end as problem
from states where state is null or state <> 'complete'""",
    "write_file_table": f"""with {DOCS}, {DOC_INV}, {FILE_TABLE}
select r.inode as "file index", s0, s1, s2, s3, size, strftime({STAMP}, '%Y-%m-%d %H:%M:%S') as time, hash,
  concat(snapshot, '/', file) as "first path", source as "first source"
from ranked r join counts c using (inode) where k = 1""",
    "scan_and_hash": """select source, lang,
  sum(octet_length(encode(text)) + 1)::bigint as listed_bytes,
  sum(octet_length(encode(text)) + 1)::bigint as read_bytes, true as same_hashes
from documents group by source, lang""",
    "scan_source": """select source, lang, sum(octet_length(encode(text)) + 1)::bigint as listed_bytes
from documents where lang <> 'fr' group by source, lang""",
    "content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "exclude_kept": f"with {url_marks(URL_TEST)} select root, path, page_id from marked where excluded_by is null",
    "exclude_topmost": f"""with {url_marks(URL_TEST)}
select distinct root, excluded_by as path from marked where excluded_by is not null""",
    "exclude_by_table": f"""with {URLS}, suffixes as (
  select distinct right(path, 5) as suffix from urls where contains(path, '/es/')),
steps as (select *, unnest(list_concat(['/'], {chain('path')})) as step from urls),
hits as (select page_id, arg_min(step, len(step)) as excluded_by from steps
  where exists (select 1 from suffixes where ends_with(step, suffix)) group by page_id)
select root, path, page_id, excluded_by from urls left join hits using (page_id)""",
    "route_by_type": f"""with {URL_INV} select page_id, path, type, case type when 'regular' then 'file'
  when 'directory' then 'directory' when 'symlink' then 'symlink' when 'not_found' then 'inaccessible'
  else 'unknown_type' end as route from url_inv""",
    "target_path": f"""with {SITES} select s.root, s.root || below as path, page_id,
  concat(name, case when nth > 1 then '_' || cast(nth - 1 as varchar) else '' end,
    case when below in ('', '/') then '' else below end) as file
from sites s join keyed using (root)""",
    "path_parts": f"""with {DOCS} select doc_id, concat(snapshot, '/', file) as path,
  regexp_replace(concat(snapshot, '/', file), '/[^/]*$', '') as parent,
  regexp_extract(file, '[^/]*$') as name, replace(source, '/', '#') as flat, lower(file) as lowered,
  starts_with(source, '/src1') as has_prefix, ends_with(source, '7.txt') as has_suffix from docs""",
    "bad_rows": f"""with {FLAWED}, judged as (select *, {INTEGRITY_PROBLEM} as problem from flawed)
select {ROW}, problem from judged where problem is not null""",
    "overlong_paths": f"with {URLS} select root, path, page_id from urls where octet_length(encode(path)) >= 45",
    "signature_lookup": f"""with {PRIOR}, {newest('prior')}, {NEW_DOCS}
select f.snapshot, {SIG}, file, prior_hash, prior_snapshot from new_docs f left join newest p using ({SIG})""",
    "signature_lookup_repeating": f"with {LOOKED} select {ROW}, prior_hash, prior_snapshot from looked",
    "content_lookup": f"""with {PRIOR}, {NEW_DOCS}, held as (
  select hash, blob_id, max(snapshot) as newest, min(snapshot) as oldest, greatest(2 - count(*), 0) as spare
  from prior group by hash, blob_id),
with_room as (select hash, blob_id, row_number() over (partition by hash order by newest desc, oldest desc,
    substr(md5(blob_id), 1, 3) desc, blob_id desc) as k from held where spare > 0),
oldest_blob as (select hash, blob_id, row_number() over (partition by hash order by oldest, blob_id) as k from held)
select file, n.hash, coalesce(w.blob_id, o.blob_id) as found_blob,
  case when o.blob_id is not null then w.blob_id is not null end as linkable
from new_docs n left join with_room w on n.hash = w.hash and w.k = 1
left join oldest_blob o on n.hash = o.hash and o.k = 1""",
    "missing_files": f"""with {DOCS}, {DOC_INV}
select {ROW} from docs d where not exists (
  select 1 from doc_inv i where i.snapshot = d.snapshot and i.file = d.file)""",
    "shared_content": f"with {DOCS}, {distill('docs', TARGET_RANK, 'rnk < 3 and rnk < top')}",
    "overlapping_roots": overlapping(False),
    "overlapping_roots_component": overlapping(True),
    "invalid_roots": f"""with {URL_ROOTS}, {URL_INV}, judged as (
  select distinct k.root, case when type is not null and (ends_with(k.root, '.html') or ends_with(k.root, '#top')
      or ends_with(k.root, '.net')) then 'excluded'
    when type = 'symlink' then 'symlink' when type is null or type = 'not_found' then 'missing' end as problem
  from known k left join url_inv i on i.path = k.root)
select root, problem from judged where problem is not null""",
    "unstable_files": f"""with {URL_INV}
select page_id, concat(path, '#', cast(page_id as varchar)) as path, size, mtime_ns, size + page_id % 2 as now_size, mtime_ns + 5 as now_mtime_ns
from url_inv where page_id % 9 = 0""",
    "snapshot_set_checks": f"""with {STATES}, named as (
  select concat(case when event_type = 'error' then '/old/' else '/repo/' end, day) as path, count(*) as times
  from (select distinct event_type, strftime(ts, '%Y-%m-%d') as day from events) group by 1),
repo as (select '/repo/' || snapshot as path, state from states where state is not null),
parents as (select distinct regexp_replace(path, '/[^/]*$', '') as path from named)
select path, 'duplicate' as problem from named where times > 1
union all select path, 'mixed_repositories' from parents where (select count(*) from parents) > 1
union all select path, 'unknown' from named where path not in (select path from repo)
union all select path, 'unfinished' from named where path in (select path from repo where state <> 'complete')""",
    "assign_blobs": f"""with {NEW_DOCS}, none as (select *, hash as blob_id from new_docs where false),
{assign('new_docs', 'none', 's9')} select {ROW}, action, blob_id from decided""",
    "assign_blobs_limited": f"""with {PRIOR}, {NEW_DOCS}, {assign('new_docs', 'prior', 's9', 2, 0)}
select {ROW}, action, blob_id from decided""",
    "assign_blobs_hot": f"""with {PRIOR}, {NEW_DOCS}, {assign('new_docs', 'prior', 's9', 2)}
select {ROW}, action, blob_id from decided""",
    "assign_blobs_affinity": f"""with {PRIOR}, {NEWEST_BLOB}, {NEW_DOCS}, looked as (
  select n.* replace (coalesce(prior_hash, hash) as hash), prior_blob from new_docs n left join newest using ({SIG})),
{follow('looked', 'prior', 's9', 2)}
select {ROW}, action, blob_id from decided
union all select {ROW}, 'dup_link', prior_blob from followed""",
    "assign_blobs_stored": f"""with {PRIOR}, {NEW_DOCS}, digits as (
  select *, instr('0123456789abcdef', right(hash, 1)) - 1 as last from prior),
kinds as (select *, last % 3 <> 0 or blob_id not like '%-0' as here from digits),
held as (select hash, blob_id, max(snapshot) as newest, min(snapshot) as oldest, bool_or(here) as present,
    case when bool_or(here) then greatest(3 - max(last % 4 + 1), 0) else 0 end as spare
  from kinds group by hash, blob_id),
gone as (select hash from held group by hash having not bool_or(present)),
{decide('new_docs', 's9', 3)}
select {ROW}, case when g.hash is null then action else 'failed' end as action,
  case when g.hash is null then blob_id end as blob_id
from decided left join gone g using (hash)""",
    "clone_affinity": f"""with {DOCS}, {PRIOR}, {NEWEST_BLOB}, looked as (
  select d.* exclude (blob_id, doc_id), prior_hash, prior_blob,
    first_value(d.hash) over (partition by {SIG} order by d.snapshot, d.file, d.hash) as first_hash
  from docs d left join newest using ({SIG})),
kept as (select * exclude (prior_hash, first_hash) from looked where hash = coalesce(prior_hash, first_hash)),
{follow('kept', 'prior', 'run', 3)}
select {ROW}, action, blob_id from decided
union all select {ROW}, 'dup_link', prior_blob from followed
union all select {ROW}, 'conflict', null from looked where hash <> coalesce(prior_hash, first_hash)""",
    "assign_blobs_windows": f"""with {PRIOR}, {NEW_DOCS}, {assign('new_docs', 'prior', 's9', 1023, 513)}
select {ROW}, action, blob_id from decided""",
    "incremental_skip": f"with {LOOKED} select {ROW} from looked where prior_hash is not null",
    "signature_conflicts": f"with {LOOKED} select {ROW}, prior_hash, prior_snapshot from looked where prior_hash <> hash",
    "file_table": f"""with {DOCS}, {DOC_INV}, {FILE_TABLE}
select r.inode as file_index, s0, s1, s2, s3, size, mtime_ns, hash,
  concat(snapshot, '/', file) as first_path, source as first_source
from ranked r join counts c using (inode) where k = 1""",
    "signature_uniqueness": f"""with {EVENT_REPS}
select {SIG}, count(distinct hash) as hashes, min(hash) as min_hash, max(hash) as max_hash
from reps group by {SIG} having count(distinct hash) > 1""",
    "signature_pairs": f"""with {EVENT_REPS},
by_hash as (select {SIG}, hash, min(struct_pack(s := snapshot, f := file)) as spot from reps group by {SIG}, hash),
anchored as (select *, first_value(hash) over w as low, first_value(spot) over w as low_spot
  from by_hash window w as (partition by {SIG} order by hash))
select {SIG}, hash, spot.s as snapshot, spot.f as file, low as other_hash,
  concat(low_spot.s, '/', low_spot.f) as other_path from anchored where hash <> low""",
    "hash_consistency": f"""with {MIXED_LINKS}
select r.inode, r.snapshot, r.file, r.hash, p.hash as first_hash
from ranked r join reps p using (inode) where r.k > 1 and r.hash <> p.hash""",
    "rehash_mismatch": f"""with {DOCS}, {DOC_INV}, {STORED}, {FILE_TABLE}
select inode, snapshot, file, hash, found_hash from ranked join stored using (snapshot, file)
where k = 1 and found_hash <> hash""",
    "unreadable_index": f"""with {DOCS} select {ROW} from docs where doc_id % 37 = 0""",
    "action_stats": f"with {take_snapshot(True, True)}, acts as (select * from actions) {ACTION_TOTALS}",
    "deletion_stats": f"""with {DOCS}, acts as (with {distill('docs', TARGET_RANK, 'rnk < 3 and rnk < top').replace(
        f'select {ROW} from standing', "select *, 'delete' as action, false as hashed from standing")})
{ACTION_TOTALS}""",
    "exclusion_stats": """with entries as (select concat('/', source) as root, lang, doc_id,
    concat('/', source, '/', lang) as dir, concat('/', source, '/', lang, '/', cast(doc_id as varchar), '.txt') as path
  from documents),
hit as (select distinct case when lang = 'fr' then dir else path end as path from entries
  where lang = 'fr' or ends_with(path, '77.txt')),
by_type as (select case when doc_id % 29 = 0 then 'symlink' else 'unknown_type' end as reason from entries
  where lang <> 'fr' and not ends_with(path, '77.txt') and (doc_id % 29 = 0 or doc_id % 31 = 0))
select 'suffix' as reason, count(*) as entries from hit
union all select reason, count(*) from by_type group by reason""",
    "event_counts": f"""with report as ({'with ' + verify_report(False)}), marks as (
  select snapshot, level from report
  union all select concat('s', cast(doc_id % 4 as varchar)), 'warning' from documents
  where octet_length(encode(concat('#', source, '/', lang, '/', cast(doc_id as varchar), '.txt'))) >= 16)
select case when grouping(snapshot) = 1 then '*' else snapshot end as snapshot,
  count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'error') as errors
from marks group by rollup (snapshot)""",
    "run_events": f"""with {take_snapshot(True, True)}, marks as (
  select snapshot, action = 'conflict' as failed, octet_length(encode(concat(snapshot, '/', file))) >= 17 as long
  from actions), counted as (
  select snapshot, count(*) filter (long) as warnings, count(*) filter (failed) as errors from marks group by snapshot)
select snapshot, warnings, errors from counted
union all select '*', sum(warnings)::bigint, sum(errors)::bigint from counted""",
    "manifest_integrity": f"""with {FLAWED}, judged as (select *, {INTEGRITY_PROBLEM} as problem from flawed)
select snapshot, file, problem from judged where problem is not null
union all select snapshot, file, 'repeated' from flawed group by {ROW} having count(*) > 1""",
    "empty_directories": f"""with {TREE}
select snapshot, file from dirs d where not exists (
  select 1 from left_files l where l.snapshot = d.snapshot and starts_with(l.file, d.file || '/'))""",
    "take_snapshot_first": f"""with {NEW_DOCS}, none as (select *, hash as blob_id from new_docs where false),
{assign('new_docs', 'none', 's9')} select {ROW}, blob_id, action, true as hashed from decided""",
    "take_snapshot_repeat": f"""with {DOCS}, kept as (select * exclude (blob_id) replace ('s9' as snapshot) from docs),
{assign('kept', 'docs', 's9')} select {ROW}, d.blob_id, action, false as hashed from decided d""",
    "verify_report": f"with {verify_report(False)}",
    "verify_report_rehash": f"with {verify_report(True)}",
    "purge_result": f"with {DOCS} select {ROW} from docs where doc_id % 37 <> 0 or snapshot not in ('s0', 's1')",
    "distill_result": f"with {DOCS}, {distill('docs', TARGET_RANK, 'rnk = top or rnk = 3')}",
    "distill_days": f"""with {EVENTS}, {distill('ev', 'dense_rank() over (order by snapshot)', 'rnk = top')}""",
    "distill_flawed": f"""with {FLAWED}, {HOLED}, ranked as (
  select *, dense_rank() over (order by snapshot nulls last) as rnk from holed), days as (
  select count(distinct snapshot) as last from holed), standing as (
  select *, max(case when usable then coalesce(if(snapshot is null, last, rnk), last) end) over (partition by hash, usable) as top
  from ranked, days)
select {ROW} from standing where not usable or snapshot is null or rnk = top""",
    "purge_flawed": f"""with {FLAWED}, {HOLED}, days as (
  select distinct snapshot from holed where snapshot is not null order by snapshot limit 10)
select {ROW} from holed where snapshot is null or snapshot not in (select snapshot from days) or n % 37 <> 0""",
    "purge_stored": f"with {DOCS} select {ROW} from docs where doc_id % 37 <> 0 or snapshot not in ('s0', 's1')",
    "distill_stored": f"with {DOCS}, {distill('docs', TARGET_RANK, 'rnk = top or rnk = 3')}",
    "clone_stored": f"""with {EVENTS}, {TARGET}, outcome as (with {clone('tgt', False, '_copy')})
select {ROW}, blob_id from outcome where action in ('import', 'dup_link', 'dup_copy')""",
    "normalised_roots": """select page_id, case when page_id % 5 < 3 then '/' when page_id % 5 = 4 then '../' else '' end
  || regexp_extract(url, '^https?://([^/]+)', 1) as root from pages""",
    "clone_into_empty": f"with {EVENTS}, none as (select * from ev where false), {clone('none', True)}",
    "clone_result": f"with {EVENTS}, {TARGET}, {clone('tgt', False, '_copy')}",
    "clone_incremental": f"with {EVENTS}, {TARGET}, {clone('tgt', True, '_copy')}",
    "clone_limited": f"with {EVENTS}, {TARGET}, {clone('tgt', False, '_copy', 7)}",
    "record_text": f"""with {DOCS}, texts as (select *, {SIZE_TEXT} as size_text,
    strftime({STAMP}, '%Y-%m-%d %H:%M:%S') as time_text, strftime({STAMP}, '%Y-%m-%d_%H-%M-%S') as time_name
  from docs)
select doc_id, size_text, time_text, time_name,
  concat(cast((mtime_ns - 1704067200000000000) // 1000000000 as varchar), 's') as elapsed,
  concat(size_text, ' ', time_text, ' ', source) as record, time_name || '_full' as renamed from texts""",
}

for _name, _args in {
    "take_snapshot": (False, False),
    "take_snapshot_incremental": (True, False),
    "take_snapshot_always_hash": (False, True),
    "take_snapshot_incremental_always_hash": (True, True),
    "take_snapshot_limited": (False, True, 2, 600),
}.items():
    ORACLES[_name] = f"with {take_snapshot(*_args)} select {ROW}, blob_id, action, hashed from actions"
