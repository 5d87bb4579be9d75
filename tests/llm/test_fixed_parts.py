"""What the contracts fix, in SQL over the given tables; the methods' own columns are tested elsewhere."""

import duckdb
import pytest

from stayscope.llm.queries import QUERIES, URL_LIST

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLACES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def _fits(words):
    return " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))


SQL = {
    "op2_quality_rules": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
g as (
  select doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] as gram
  from w, unnest(range(1, len(words) - 1)) p(pos)
), again as (select doc_id, gram from g group by all having count(*) > 1),
marked as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as at from g join again using (doc_id, gram)),
r as (select doc_id, count(*) as n from marked group by 1),
l as (
  select doc_id, sum(n - 1)::bigint as n from (
    select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by 1
)
select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines,
  coalesce(r.n, 0)::bigint as n_repeat_words, len(words) < 50 or 100 * coalesce(r.n, 0) > 50 * len(words) as base_failed
from w left join l using (doc_id) left join r using (doc_id)""",
    "op3_url_rules": f"""
with c as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') as path from c),
r as (select * from (values {", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for v, r in URL_LIST)}) t(verdict, rule, rh, rp))
select page_id, host, path, (select arg_max(rule, length(rule)) from r
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule from h""",
    "op6_license_scan": f"""
with w as (select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
p as ({" union all ".join(f"select doc_id, '{label}' as label, i - 1 as spot from w, unnest(range(1, len(w) + 1)) u(i) where {_fits(words)}" for label, words in PLACES.items())}),
f as (select doc_id, count(*) as n, min(spot) as lo, max(spot) as hi, string_agg(distinct label, ',' order by label) as labels from p group by 1)
select w.doc_id, len(w)::bigint as n_words, coalesce(f.n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
  coalesce(labels, '') as base_labels from w left join f using (doc_id)""",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_fixed_columns_equal_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_shards_are_gapless_and_move_only_into_the_new_one(spark, folder):
    rows = QUERIES["op7_rendezvous_shards"](spark, folder).collect()
    con = duckdb.connect()
    import zlib

    texts = con.sql(f"select doc_id, coalesce(text, '') from '{folder}/documents.parquet'").fetchall()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts}
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
