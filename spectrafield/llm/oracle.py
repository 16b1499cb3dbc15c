"""DuckDB SQL for the queries of this subpackage that SQL can express: brute force over all pairs, and the template written out."""

from __future__ import annotations

from .chat import CONTROL


def _quoted(rest: str) -> str:
    return "".join("\\" + c if c in "|[]" else c for c in rest)


def _escaped(text: str) -> str:
    """SQL of the template's escapes; what follows a control string's first character cannot begin another one."""
    for first in "<[":
        rest = "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == first)
        begin = "\\[" if first == "[" else first
        text = rf"regexp_replace({text}, '({begin})(\\*)({rest})', '\1\\\2\3', 'g')"
    return text


#: Components of ``links`` (a, b, both ways) among ``members`` (id): each id with the least one that it reaches.
COMPONENTS = """reached(id, other) as (select id, id from members union select r.id, l.b from reached r join links l on l.a = r.other),
 named as (select id, min(other) least from reached group by 1), counted as (select a id, count(*) n from links group by 1)"""

#: Unsigned CRC-32 of an ASCII string: every character is followed by its eight shifts.
def _crc32(text: str) -> str:
    step = "xor((z >> 1), 3988292384 * (z & 1))".replace("z", "xor(acc, x)")
    # the value of a character comes with its first shift, the other seven change nothing else
    events = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({events}, lambda acc, x: {step}, 4294967295::bigint), 4294967295)"


def _crc32_utf8(text: str) -> str:
    """The same of any string: its UTF-8 bytes, as hexadecimal digits."""
    step = "xor((z >> 1), 3988292384 * (z & 1))".replace("z", "xor(acc, x)")
    of = f"hex(encode({text}))"
    events = f"flatten(list_transform(range(1, length({of}) + 1, 2), lambda i: [('0x' || substr({of}, i::int, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({events}, lambda acc, x: {step}, 4294967295::bigint), 4294967295)"


#: Base32 of a hexadecimal digest of 160 bits: four letters for every five digits.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({h}, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)) & 31)::int + 1, 1)), '')"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ROLE = _escaped(r"replace(role, '\', '\\')")
_FORMATTED = rf"'<|im_start|>' || replace({_ROLE}, chr(10), '\n') || chr(10) || {_escaped('text')} || '<|im_end|>' || chr(10)"
_OWN = "'</s>[INST] ok [/INST]'"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embeddings": f"""with recursive vectors as materialized (select vec_id id, embedding::double[] x from embeddings), usable as materialized (select id, x from vectors where list_dot_product(x, x) > 0 and isfinite(list_dot_product(x, x))),
 links as materialized (select p.id a, q.id b from usable p join usable q on p.id <> q.id and list_cosine_similarity(p.x, q.x) >= 0.95), members as (select id from vectors),
 {COMPONENTS} select id vec_id, coalesce(n, 0)::bigint n_links, least component_id, id = least kept from named left join counted using (id)""",
        "op4_chat": rf"""with turns as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', {_OWN} union all select -7, 1, 'assistant', {_OWN})
 select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256, sum(case when role = 'assistant' then length(text) else 0 end)::bigint loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) loss_sha256, sum(length({_FORMATTED}))::bigint formatted_chars from turns group by 1""",
        "op6_jaccard": rf"""with recursive split as (select doc_id id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
 shingles as materialized (select distinct id, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' '))) s from split where len(w) > 0), sizes as (select id, count(*) k from shingles group by 1),
 links as materialized (select p.id a, q.id b from shingles p join shingles q on p.s = q.s and p.id <> q.id join sizes m on m.id = p.id join sizes n on n.id = q.id group by 1, 2, m.k, n.k having count(*) >= 0.8 * (m.k + n.k - count(*))), members as (select doc_id id from documents),
 {COMPONENTS} select id doc_id, least class_id, coalesce(n, 0)::bigint n_links, id = least kept from named left join counted using (id)""",
            "op11_warc": f"""with held as (select page_id, coalesce(html, '') t, sha1(coalesce(html, '')) h from pages), named as (select *, {_BASE32.format(h="h")} d, max(page_id) over (partition by t) m from held)
 select page_id, strlen(t)::bigint payload_bytes, d payload_digest, case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to from named""",
        "op12_variants": f"""with recursive found as (select doc_id, unnest(regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[a-zÀ-ÿ]+')) w from documents), each_run as (select doc_id, w, count(*) k from found group by 1, 2),
 hashed as materialized (select w, k, {_crc32_utf8("doc_id || ':' || w")} h from each_run), altered as (select case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end w, k from hashed),
 words as materialized (select w, sum(k)::bigint n from altered where length(w) >= 5 group by 1 having sum(k) >= 3),
 cut as materialized (select w, n, unnest(range(1, length(w) + 1)) i from words), less as materialized (select w, n, i, substr(w, 1, i::int - 1) a, substr(w, i::int + 1) b from cut),
 pairs as (select distinct x.w, y.w o, y.n m from less x join less y on x.i = y.i and x.a = y.a and x.b = y.b and x.w <> y.w union select distinct x.w, y.w, y.n from less x join words y on y.w = x.a || x.b union select distinct y.w, x.w, x.n from less x join words y on y.w = x.a || x.b),
 near as (select w, count(*) n_near, min(o) filter (m = top) o, max(m) m from (select *, max(m) over (partition by w) top from pairs) group by 1),
 forms as materialized (select w, n, coalesce(n_near, 0)::bigint n_near, case when m >= 2 * n then o end form, case when m >= 2 * n then m end form_n from words left join near using (w)),
 walk as (select w, w at_, 0 d from forms union all select walk.w, f.form, d + 1 from walk join forms f on f.w = walk.at_ where f.form is not null), ends as (select w, arg_max(at_, d) root from walk group by 1)
 select w word, form, root, n, n_near, form_n from forms join ends using (w)""",
        "op13_trie": f"""with held as materialized (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null),
 lists as materialized (select c, list(struct_pack(r := r, t := t) order by i) l from held group by 1), heads as (select c, l, {_crc32("c::varchar")} % 9 h, c - c % 5 b from lists),
 built as materialized (select x.c, list_concat(coalesce(y.l, [])[:x.h::int], x.l[x.h::int + 1:]) l from heads x left join lists y on y.c = x.b), prefixes as materialized (select c, d, l[:d::int] p, len(l) = d last from (select c, l, unnest(range(0, len(l) + 1)) d from built)),
 nodes as materialized (select d, p, min(c) c, count(*) n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) ends, case when d > 0 then (count(*) - 1) * strlen(p[d::int].t) else 0 end saved from prefixes group by 1, 2),
 kids as (select d - 1 d, p[:d::int - 1] p, count(*) k from nodes where d > 0 group by 1, 2), full_nodes as materialized (select nodes.*, coalesce(k, 0) k from nodes left join kids on kids.d = nodes.d and kids.p = nodes.p),
 below as (select a.d, a.p, count(*) filter (b.k = 0) leaves, sum(b.saved) saved from full_nodes a join full_nodes b on b.d >= a.d and b.p[:a.d::int] = a.p group by 1, 2)
 select x.c conv_id, x.d as depth, y.c parent_conv_id, x.n n_convs, x.k n_children, leaves n_leaves, below.saved::bigint saved_tokens, x.ends ends_sha256 from full_nodes x join below on below.d = x.d and below.p = x.p left join full_nodes y on y.d = x.d - 1 and y.p = x.p[:x.d::int - 1]""",
    }
