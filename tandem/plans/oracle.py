"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The tables ``documents``, ``conversations``, ``embeddings`` and ``events`` are
views over the same parquet files. Regular-expression classes are spelled for
RE2 so that they agree with the Java classes used on the Spark side.
"""

from __future__ import annotations

# The whitespace class of Python's str.split() written for RE2,
# and the word-character class.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}"
WORD = r"\p{L}\p{N}_"
KEEP = "a-zA-ZÀ-ÿ"
# Rounds of learning, epochs of the history, pruning before composition, room for a document's lines and a conversation's turns in a sid.
EM_ROUNDS, HISTORY_EPOCHS, COMPOSE_MIN_P, STRIDE = 5, 4, 0.005, 4294967296
# The characters that clean_text deletes.
CLEAN_CHARS = "-=+,#/?:^$.@*~&%ㆍ!()[]<>"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda t: t <> '')"


def strip_special(x: str) -> str:
    return f"regexp_replace({x}, '[^{WORD}{SPACE}{KEEP}]', '', 'g')"


def ids_text(x: str) -> str:
    return f"array_to_string({x}, ',')"


P = """lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
P AS (
  SELECT doc_id * {STRIDE} + pos AS sid, lang AS region, line AS standard,
         replace(replace(replace(line, 'th', 'd'), 'qu', 'k'), 'sch', 'sh') AS dialect,
         replace(replace(replace(line, 'ou', 'u'), 'ie', 'i'), 'ción', 'sión') AS dialect2
  FROM lines)"""

PW = P + f""",
PW AS (SELECT *, {words('standard')} AS sw, {words('dialect')} AS dw, {words('dialect2')} AS d2w FROM P)"""

CLEAN = P + f""",
C1 AS (SELECT sid, region,
         replace({strip_special("coalesce(standard, 'nan')")}, '  ', ' ') AS a,
         replace({strip_special("coalesce(dialect, 'nan')")}, '  ', ' ') AS b FROM P),
C2 AS (SELECT sid, region, replace(a, 'laughing', '') AS a, replace(b, 'laughing', '') AS b FROM C1),
C AS (SELECT sid, region,
        CASE WHEN regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]') THEN '' ELSE a END AS standard,
        CASE WHEN regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]') THEN '' ELSE b END AS dialect
      FROM C2 WHERE length(CASE WHEN regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]') THEN '' ELSE a END) >= 6)"""

SPECIALS = "SELECT * FROM (VALUES ('<unk>', 0, 0), ('<pad>', 1, 0), ('<sos>', 2, 0), ('<eos>', 3, 0)) s(token, id, freq)"


def first_seen(tok_cte: str) -> str:
    """``tok_cte(k, pos, token)`` → vocab rows (token, id, freq)."""
    return f"""SELECT token, (row_number() OVER (ORDER BY fk, fp) + 3)::INT AS id, freq FROM (
  SELECT token, count(*) AS freq, arg_min(k, (k, pos)) AS fk, arg_min(pos, (k, pos)) AS fp
  FROM {tok_cte} GROUP BY token)
UNION ALL {SPECIALS}"""


def seen_vocab(col: str, name: str = "V") -> str:
    return f"""{name}T AS (SELECT sid AS k, unnest({col}) AS token, unnest(range(len({col}))) AS pos FROM PW),
{name} AS ({first_seen(name + "T")})"""


def freq_vocab(src: str, col: str, name: str = "V", limit: int = 33000) -> str:
    return f"""{name}T AS (SELECT unnest({col}) AS token FROM {src}),
{name} AS (SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 3)::INT AS id, freq FROM (
    SELECT token, count(*) AS freq FROM {name}T GROUP BY token ORDER BY freq DESC, token LIMIT {limit})
  UNION ALL {SPECIALS})"""


def encode_cte(src: str, col: str, vocab: str, name: str, sos=True, eos=True) -> str:
    pre = "[2] || " if sos else ""
    post = " || [3]" if eos else ""
    return f"""{name}X AS (SELECT sid, unnest({col}) AS token, unnest(range(len({col}))) AS pos FROM {src}),
{name}J AS (SELECT {name}X.sid, pos, coalesce({vocab}.id, 0) AS id FROM {name}X LEFT JOIN {vocab} USING (token)),
{name}G AS (SELECT sid, list(id ORDER BY pos) AS ids FROM {name}J GROUP BY sid),
{name} AS (SELECT {src}.sid, {pre}coalesce({name}G.ids, []::INT[]){post} AS ids FROM {src} LEFT JOIN {name}G USING (sid))"""


def sentences(side: str) -> str:
    return f"string_split(regexp_replace({side}, '([.!?])[{SPACE}]+', '\\1' || chr(10), 'g'), chr(10))"


SW = PW + f""",
SX AS (SELECT sid, region, unnest({sentences('standard')}) AS a, unnest({sentences('dialect')}) AS b, unnest({sentences('dialect2')}) AS c,
         unnest(range(len({sentences('standard')}))) AS sent FROM P),
SW AS (SELECT sid, region, sent, {words('a')} AS sw, {words('b')} AS dw, {words('c')} AS d2w, 1 AS k, 0 AS h FROM SX)"""


def em(src: str = "dw", trg: str = "sw", name: str = "T2", rounds: int = EM_ROUNDS, rows: str = "SW", start: str | None = None) -> str:
    """IBM Model 1 with the empty word, unrolled ``rounds`` times, on whole sentences; equal ones are one with a weight.

    ``rows`` has ``k`` (1 where a sentence is learned from) and ``h`` (1 where it is held out); ``start``: a table to go on from.
    """
    n = name
    s = f"""{n}B AS MATERIALIZED (SELECT region, sid, sent, ['<null>'] || {src} AS s, {trg} AS t, k, h FROM {rows} WHERE len({trg}) > 0),
{n}U AS MATERIALIZED (SELECT region, s, t, sum(k)::DOUBLE AS k, sum(h)::DOUBLE AS h, row_number() OVER () AS u FROM {n}B GROUP BY region, s, t),
{n}ES AS (SELECT u, l, e, count(*) AS ce FROM (SELECT u, len(s) AS l, unnest(s) AS e FROM {n}U) GROUP BY u, l, e),
{n}FS AS MATERIALIZED (SELECT region, u, k, h, nt, f, count(*) AS cf FROM
       (SELECT region, u, k, h, len(t) AS nt, unnest(t) AS f FROM {n}U) GROUP BY region, u, k, h, nt, f),
{n}CE AS MATERIALIZED (SELECT region, u, l, e, ce, f, k * cf AS w FROM {n}ES JOIN {n}FS USING (u)),
{n}W1 AS ({f"SELECT {n}CE.*, coalesce({start}.p, 0) AS tp FROM {n}CE LEFT JOIN {start} USING (region, e, f)" if start else f"SELECT *, 1.0::DOUBLE AS tp FROM {n}CE"})"""
    for r in range(1, rounds + 1):
        if r > 1:
            s += f""",
{n}W{r} AS (SELECT {n}CE.*, coalesce({n}T{r-1}.p, 0) AS tp FROM {n}CE LEFT JOIN {n}T{r-1} USING (region, e, f))"""
        none = "w * ce / l" if start and r == 1 else "0"
        s += f""",
{n}D{r} AS (SELECT *, sum(ce * tp) OVER (PARTITION BY u, f) AS dn FROM {n}W{r}),
{n}R{r} AS (SELECT region, e, f, sum(CASE WHEN dn > 0 THEN w * ce * tp / dn ELSE {none} END) AS c
       FROM {n}D{r} GROUP BY region, e, f),
{n}T{r} AS MATERIALIZED (SELECT region, e, f, coalesce(c / nullif(sum(c) OVER (PARTITION BY region, e), 0), 0) AS p FROM {n}R{r})"""
    s += f""",
{n} AS (SELECT * FROM {n}T{rounds})"""
    return s


def losses(model: str, table: str, name: str) -> str:
    """Mean over sentences of the mean over target words of -ln p, by region: of the learning and the held-out sentences."""
    m = model
    return f"""{name}F AS (SELECT u, f, sum(ce * coalesce({table}.p, 0)) / any_value(l) AS pf
       FROM {m}CE LEFT JOIN {table} USING (region, e, f) GROUP BY u, f),
{name}S AS (SELECT region, sum(-ln(greatest(pf, 1e-10)) * cf / nt * k) AS a, sum(-ln(greatest(pf, 1e-10)) * cf / nt * h) AS b
       FROM {name}F JOIN {m}FS USING (u, f) GROUP BY region),
{name}N AS (SELECT region, sum(k) AS nk, sum(h) AS nh FROM {m}U GROUP BY region),
{name} AS (SELECT region, a / nullif(nk, 0) AS train_loss, b / nullif(nh, 0) AS valid_loss FROM {name}S JOIN {name}N USING (region))"""


def best(t: str, name: str) -> str:
    return f"""{name} AS (SELECT region, e, f AS best FROM (
  SELECT region, e, f, row_number() OVER (PARTITION BY region, e ORDER BY round(p, 6) DESC, f) AS rn FROM {t})
  WHERE rn = 1)"""


def translate_cte(src: str, col: str, bt: str, name: str) -> str:
    return f"""{name}X AS (SELECT region, sid, unnest({col}) AS e, unnest(range(len({col}))) AS pos FROM {src}),
{name}J AS (SELECT {name}X.region, sid, pos, coalesce({bt}.best, {name}X.e) AS w
       FROM {name}X LEFT JOIN {bt} USING (region, e)),
{name}G AS (SELECT region, sid, string_agg(w, ' ' ORDER BY pos) AS inference FROM {name}J GROUP BY region, sid),
{name} AS (SELECT {src}.region, {src}.sid, coalesce({name}G.inference, '') AS inference
       FROM {src} LEFT JOIN {name}G USING (region, sid))"""


def bleu_ctes(src: str) -> str:
    """``src(sid, r, h)`` → ``BL(sid, bleu1..bleu4)`` unrounded."""
    def grams(col, nm):
        return f"""{nm} AS (SELECT sid, n, g, count(*) AS c FROM (
    SELECT sid, n, array_to_string({col}[i + 1 : i + n], ' ') AS g FROM (
      SELECT sid, {col}, n, unnest(range(0, len({col}) - n + 1)) AS i
      FROM {src}, (VALUES (1), (2), (3), (4)) v(n) WHERE len({col}) >= n)) GROUP BY sid, n, g)"""
    lp = ["ln(m1 / greatest(t1, 1))"] + [f"ln((m{k} + 1) / (greatest(t{k}, 1) + 1))" for k in range(2, 5)]
    cols = []
    for n in range(1, 5):
        s = " + ".join(lp[:n])
        cols.append(f"CASE WHEN m1 = 0 THEN 0.0 ELSE bp * exp(({s}) / {n}) END AS bleu{n}")
    return f"""{grams('h', 'HG')},
{grams('r', 'RG')},
MM AS (SELECT HG.sid, HG.n, sum(least(HG.c, coalesce(RG.c, 0))) AS m, sum(HG.c) AS t
       FROM HG LEFT JOIN RG USING (sid, n, g) GROUP BY HG.sid, HG.n),
AG AS (SELECT {src}.sid, len(h) AS hl, len(r) AS rl,
  {", ".join(f"coalesce(sum(CASE WHEN n = {k} THEN m END), 0) AS m{k}" for k in range(1, 5))},
  {", ".join(f"coalesce(sum(CASE WHEN n = {k} THEN t END), 0) AS t{k}" for k in range(1, 5))}
  FROM {src} LEFT JOIN MM USING (sid) GROUP BY {src}.sid, hl, rl),
AB AS (SELECT *, CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1 - rl / hl) END AS bp FROM AG),
BL AS (SELECT sid, {", ".join(cols)} FROM AB)"""


def bleu_round(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}bleu{n}, 6) AS bleu{n}" for n in range(1, 5))


EPOCHS = """EV AS (SELECT event_type AS run, CAST(ts AS DATE) AS day, event_id, ts, value FROM events),
ED AS (SELECT run, day, round(avg(value) / 10, 6) AS valid_loss,
         round(avg(CASE WHEN event_id % 2 = 0 THEN value END) / 10, 6) AS train_loss,
         min(ts) AS start_ts, max(ts) AS end_ts FROM EV GROUP BY run, day),
EL AS (SELECT run, datediff('day', min(day) OVER (PARTITION BY run), day) AS epoch,
         train_loss, valid_loss, start_ts, end_ts FROM ED)"""


def streak(src: str, loss: str, name: str, out: str) -> str:
    return f"""{name}1 AS (SELECT *, floor(exp({loss}))::BIGINT AS ppl_{out} FROM {src}),
{name}2 AS (SELECT *, coalesce(ppl_{out} > lag(ppl_{out}) OVER (PARTITION BY run ORDER BY epoch), false) AS up_{out}
       FROM {name}1),
{name}3 AS (SELECT *, sum(CASE WHEN up_{out} THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl_{out} FROM {name}2),
{name} AS (SELECT *, sum(up_{out}::INT) OVER (PARTITION BY run, isl_{out} ORDER BY epoch
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS {out} FROM {name}3)"""


def _lexicon_pw(src="dw", trg="sw", name="T2"):
    return "WITH " + SW + ",\n" + em(src, trg, name)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    w = "WITH "
    # sources / sinks (round trips compare with the data written)
    q["read_utterances"] = w + P + """
SELECT region, (sid % {STRIDE}) AS pos, standard AS standard_form, dialect AS dialect_form FROM P"""
    q["cap_per_group"] = """SELECT doc_id, source, lang, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20"""
    q["read_pairs_csv"] = w + P + """
SELECT sid, region, nullif(standard, '') AS standard, nullif(dialect, '') AS dialect FROM P"""
    q["read_column_json"] = w + P + "\nSELECT sid, standard, dialect FROM P"
    q["read_column_json_split"] = q["read_column_json"]
    q["read_utterances_capped"] = """SELECT lang AS region, least(count(*), 3) AS n_files, least(count(*), 3) AS n_whole
FROM documents WHERE text IS NOT NULL GROUP BY lang"""
    q["write_pairs"] = w + P + "\nSELECT sid, region, standard, dialect FROM P"
    q["write_pairs_json"] = w + P + "\nSELECT sid, standard, dialect FROM P"
    # projections / cleaning
    q["project_pairs"] = w + P + "\nSELECT sid, dialect2 AS standard, dialect FROM P"
    q["drop_non_text"] = w + P + "\nSELECT sid FROM P WHERE nullif(standard, '') IS NOT NULL"
    q["strip_special"] = w + P + f"\nSELECT sid, {strip_special('standard')} AS v FROM P"
    q["squeeze_spaces"] = w + P + f"\nSELECT sid, replace({strip_special('standard')}, '  ', ' ') AS v FROM P"
    q["strip_marker"] = w + P + "\nSELECT sid, replace(standard, 'eau', '') AS v FROM P"
    q["blank_if_match"] = w + P + """
SELECT sid, CASE WHEN regexp_matches(standard, '[0-9]') OR regexp_matches(dialect, '[0-9]') THEN '' ELSE standard END AS standard,
       CASE WHEN regexp_matches(standard, '[0-9]') OR regexp_matches(dialect, '[0-9]') THEN '' ELSE dialect END AS dialect FROM P"""
    q["drop_short"] = w + P + "\nSELECT sid FROM P WHERE length(standard) >= 6"
    q["clean_pairs"] = w + CLEAN + "\nSELECT sid, standard, dialect FROM C"
    q["normalize_hangul"] = w + P + f"""
SELECT sid, regexp_replace(regexp_replace(standard, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '[^a-zA-ZÀ-ÿ ]', '', 'g') AS v FROM P"""
    q["clean_text"] = w + P + f"\nSELECT sid, translate(standard, '{CLEAN_CHARS}', '') AS v FROM P"
    q["filter_max_len"] = w + PW + """
SELECT sid, 'word' AS level FROM PW WHERE len(dw) < 30 AND len(sw) < 30
UNION ALL SELECT sid, 'syl' AS level FROM PW WHERE length(dialect) < 110 AND length(standard) < 110"""
    q["dense_index"] = w + CLEAN + "\nSELECT sid, row_number() OVER (ORDER BY sid) - 1 AS idx FROM C"
    q["orient"] = w + P + "\nSELECT sid, standard AS src, dialect AS trg FROM P"
    q["contains_digit"] = w + P + "\nSELECT sid, regexp_matches(standard, '\\p{Nd}') AS has_digit FROM P"
    q["head_rows"] = w + P + "\nSELECT sid, region, standard FROM P ORDER BY sid LIMIT 100"
    # set ops / splits
    q["union_regions"] = w + P + """
SELECT row_number() OVER (ORDER BY region NULLS FIRST, sid) - 1 AS sid, region FROM P"""
    split = """CI AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS i, count(*) OVER () AS n FROM C)"""
    q["split_ordered"] = w + CLEAN + ",\n" + split + """
SELECT sid, CASE WHEN i < n * 9 // 10 THEN 'train' WHEN i < n * 95 // 100 THEN 'valid' ELSE 'test' END AS split FROM CI"""
    q["split_half"] = w + CLEAN + ",\n" + split + """
SELECT sid, CASE WHEN i < n // 2 THEN 'valid' ELSE 'test' END AS split FROM CI"""
    # tokens
    q["syllables"] = w + P + """,
S AS (SELECT sid, list_filter(string_split(standard, ''), lambda t: t <> '') AS s FROM P)
SELECT sid, len(s) AS n, array_to_string(s, '|') AS toks FROM S"""
    q["words"] = w + PW + "\nSELECT sid, len(sw) AS n, array_to_string(sw, '|') AS toks FROM PW"
    prefix = CLEAN + f""",
CW AS (SELECT sid, {words('standard')} AS w FROM C),
WC AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest(w) AS token FROM CW) GROUP BY token),
PC AS MATERIALIZED (SELECT substring(word, 1, k) AS prefix, sum(n)::BIGINT AS cnt FROM (
        SELECT word, n, unnest(range(1, least(length(word), 10) + 1)) AS k FROM WC) GROUP BY prefix),
CO AS (SELECT p.prefix AS word, pow(p.cnt / f.cnt, 1.0 / (length(p.prefix) - 1)) AS cohesion
       FROM PC p JOIN (SELECT * FROM PC WHERE length(prefix) = 1) f ON f.prefix = substring(p.prefix, 1, 1)
       WHERE length(p.prefix) >= 2 AND p.cnt >= 5)"""
    q["prefix_counts"] = w + prefix + "\nSELECT prefix, cnt FROM PC"
    q["cohesion_scores"] = w + prefix + "\nSELECT word, round(cohesion, 6) AS cohesion FROM CO"
    q["tokenize_lr"] = w + prefix + """,
CAND AS (SELECT word, k, substring(word, 1, k) AS prefix FROM (
          SELECT word, unnest(range(2, length(word) + 1)) AS k FROM WC WHERE length(word) > 2)),
BEST AS (SELECT word, k FROM (SELECT CAND.word, k, row_number() OVER (PARTITION BY CAND.word
          ORDER BY coalesce(CO.cohesion, 0.0) DESC, k DESC) AS rn FROM CAND LEFT JOIN CO ON CO.word = CAND.prefix) WHERE rn = 1),
OCC AS (SELECT sid, unnest(w) AS token, unnest(range(len(w))) AS pos FROM CW),
PARTS AS (SELECT sid, pos, CASE WHEN BEST.word IS NULL THEN [token]
            ELSE list_filter([substring(token, 1, BEST.k), substring(token, BEST.k + 1)], lambda t: t <> '') END AS v
          FROM OCC LEFT JOIN BEST ON BEST.word = OCC.token),
G AS (SELECT sid, flatten(list(v ORDER BY pos)) AS toks FROM PARTS GROUP BY sid)
SELECT CW.sid, coalesce(array_to_string(G.toks, ' '), '') AS toks FROM CW LEFT JOIN G USING (sid)"""
    q["lower_tokens"] = w + PW + "\nSELECT sid, array_to_string(list_transform(sw, lambda t: lower(t)), ' ') AS toks FROM PW"
    # vocabularies
    q["vocab_first_seen"] = w + PW + """,
TK AS (SELECT sid AS k, unnest(sw) AS token, unnest(range(len(sw))) AS pos FROM PW)
""" + first_seen("TK")
    q["save_table"] = q["vocab_first_seen"]
    q["vocab_by_freq"] = w + PW + """,
LW AS (SELECT sid, list_transform(sw, lambda t: lower(t)) AS lw FROM PW),
""" + freq_vocab("LW", "lw") + "\nSELECT token, id, freq FROM V"
    q["shared_vocab"] = w + PW + """,
TK AS (SELECT (0, sid) AS k, unnest(dw) AS token, unnest(range(len(dw))) AS pos FROM PW
       UNION ALL SELECT (1, sid) AS k, unnest(sw) AS token, unnest(range(len(sw))) AS pos FROM PW)
""" + first_seen("TK")
    q["vocab_stats"] = w + PW + """
SELECT 'standard' AS side, (count(DISTINCT t) + 4) AS vocab_size FROM (SELECT unnest(sw) AS t FROM PW)
UNION ALL SELECT 'dialect' AS side, (count(DISTINCT t) + 4) AS vocab_size FROM (SELECT unnest(dw) AS t FROM PW)"""
    q["vocab_preview"] = w + PW + """,
T AS (SELECT region, 'standard' AS side, unnest(sw) AS t FROM PW UNION ALL SELECT region, 'dialect' AS side, unnest(dw) AS t FROM PW)
SELECT region, side, count(DISTINCT t) + 4 AS vocab_size, true AS close FROM T GROUP BY region, side
UNION ALL SELECT 'all', side, count(DISTINCT t) + 4, true FROM T GROUP BY side
UNION ALL SELECT 'all', 'all', count(DISTINCT t) + 4, true FROM T"""
    q["top_tokens"] = w + PW + """,
LW AS (SELECT sid, list_transform(sw, lambda t: lower(t)) AS lw FROM PW),
""" + freq_vocab("LW", "lw") + "\nSELECT token, freq FROM V WHERE id >= 4 ORDER BY freq DESC, token LIMIT 20"
    enc = w + PW + ",\n" + seen_vocab("dw") + ",\n" + encode_cte("PW", "dw", "V", "EN")
    q["encode"] = enc + f"\nSELECT sid, {ids_text('ids')} AS ids FROM EN"
    dec = enc + """,
DX AS (SELECT sid, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM EN),
DJ AS (SELECT DX.sid, pos, coalesce(V.token, '<unk>') AS token FROM DX LEFT JOIN V USING (id)),
DEC AS (SELECT sid, list(token ORDER BY pos) AS tokens FROM DJ GROUP BY sid)"""
    q["decode"] = dec + "\nSELECT sid, array_to_string(tokens, ' ') AS text FROM DEC"
    q["truncate_at_special"] = dec + f""",
TJ AS (SELECT sid, array_to_string(tokens[2:], ' ') AS j FROM DEC)
SELECT sid, CASE WHEN strpos(j, '<') > 0
  THEN regexp_replace(substring(j, 1, strpos(j, '<') - 1), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') ELSE j END AS text FROM TJ"""
    q["encode_pairs"] = w + PW + ",\n" + seen_vocab("dw", "SV") + ",\n" + seen_vocab("sw", "TV") + ",\n" \
        + encode_cte("PW", "dw", "SV", "ES") + ",\n" + encode_cte("PW", "sw", "TV", "ET") + f"""
SELECT ES.sid, {ids_text('ES.ids')} AS src_ids, {ids_text('ET.ids')} AS trg_ids FROM ES JOIN ET USING (sid)"""
    q["join_tokens"] = w + PW + """
SELECT sid, array_to_string(list_filter(string_split(standard, ''), lambda t: t <> ''), '') AS syl_text,
       array_to_string(sw, ' ') AS word_text FROM PW"""
    ext = w + PW + ",\n" + seen_vocab("sw") + """,
VN AS (SELECT count(*) AS n FROM V),
IX AS (SELECT sid, unnest(dw) AS token, unnest(range(len(dw))) AS pos FROM PW),
IJ AS (SELECT IX.sid, pos, coalesce(V.id, (SELECT n FROM VN) + pos)::INT AS id FROM IX LEFT JOIN V USING (token)),
IG AS (SELECT sid, list(id ORDER BY pos) AS ids FROM IJ GROUP BY sid),
OX AS (SELECT sid, unnest(sw) AS token, unnest(range(len(sw))) AS pos, dw FROM PW),
OJ AS (SELECT OX.sid, pos, coalesce(V.id, CASE WHEN list_position(dw, token) IS NOT NULL
          THEN list_position(dw, token) - 1 + (SELECT n FROM VN) ELSE 3 END)::INT AS id FROM OX LEFT JOIN V USING (token)),
OG AS (SELECT sid, list(id ORDER BY pos) AS ids FROM OJ GROUP BY sid),
EXT AS (SELECT PW.sid, PW.dw, coalesce(IG.ids, []::INT[]) AS in_ids, coalesce(OG.ids, []::INT[]) AS out_ids
        FROM PW LEFT JOIN IG USING (sid) LEFT JOIN OG USING (sid))"""
    q["encode_extended"] = ext + f"\nSELECT sid, {ids_text('in_ids')} AS in_ids, {ids_text('out_ids')} AS out_ids FROM EXT"
    q["decode_extended"] = ext + """,
HD AS (SELECT sid, dw, out_ids[1 : len(list_filter(out_ids, lambda x: x <> 0))] AS h FROM EXT),
HX AS (SELECT sid, dw, unnest(h) AS id, unnest(range(len(h))) AS pos FROM HD),
HJ AS (SELECT HX.sid, pos, CASE WHEN HX.id < (SELECT n FROM VN) THEN coalesce(V.token, '<unk>')
          ELSE coalesce(dw[HX.id - (SELECT n FROM VN) + 1], '<???>') END AS w FROM HX LEFT JOIN V USING (id)),
HG AS (SELECT sid, string_agg(w, ' ' ORDER BY pos) AS text FROM HJ GROUP BY sid)
SELECT EXT.sid, coalesce(HG.text, '') AS text FROM EXT LEFT JOIN HG USING (sid)"""
    q["oov_to_unk"] = enc + "\nSELECT sid, array_to_string(list_transform(ids, lambda x: CASE WHEN x > 1000 THEN 0 ELSE x END), ',') AS ids FROM EN"
    q["one_hot"] = enc + "\nSELECT sid, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM EN"
    q["trim_at"] = enc + """
SELECT sid, array_to_string(CASE WHEN list_position(ids, 5) IS NOT NULL THEN ids[1 : list_position(ids, 5)] ELSE ids END, ',') AS ids FROM EN"""
    q["seq_length"] = enc + "\nSELECT sid, coalesce(list_position(ids, 5), len(ids))::INT AS n FROM EN"
    q["truncate_at_eos"] = enc + """
SELECT sid, array_to_string(CASE WHEN list_position(ids, 3) IS NOT NULL THEN ids[1 : list_position(ids, 3) - 1] ELSE ids END, ',') AS ids FROM EN"""
    # cells, batches
    q["top_n_cells"] = """SELECT vec_id AS "row", col, round(value::DOUBLE, 6) AS value FROM (
  SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS col FROM embeddings)
ORDER BY value DESC, vec_id, col LIMIT 10"""
    batch = w + PW + """,
BI AS (SELECT sid, len(sw) AS l, (row_number() OVER (ORDER BY len(sw), sid) - 1) // 64 AS batch FROM PW),
BB AS (SELECT sid, batch, row_number() OVER (PARTITION BY batch ORDER BY l DESC, sid) AS rank_in_batch FROM BI)"""
    q["bucket_batches"] = batch + "\nSELECT sid, batch, rank_in_batch FROM BB"
    pad = batch + ",\n" + seen_vocab("sw") + ",\n" + encode_cte("PW", "sw", "V", "EN") + """,
PD AS (SELECT BB.sid, batch, ids, max(len(ids)) OVER (PARTITION BY batch) AS m FROM BB JOIN EN USING (sid)),
PA AS (SELECT sid, batch, ids || list_transform(range(m - len(ids)), lambda x: 1) AS ids FROM PD)"""
    q["pad_batch"] = pad + "\nSELECT sid, batch, array_to_string(ids, ',') AS ids FROM PA"
    q["pad_mask"] = pad + "\nSELECT sid, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 1 THEN 'T' ELSE 'F' END), '') AS mask FROM PA"
    q["position_ids"] = pad + """
SELECT sid, array_to_string(list_transform(ids, lambda x, i: CASE WHEN x = 1 THEN 0 ELSE i END), ',') AS ids FROM PA"""
    # joins, lexicon
    q["zip_pairs"] = w + P + """,
ZA AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS idx FROM P WHERE dialect <> standard),
ZB AS (SELECT sid AS b_sid, row_number() OVER (ORDER BY sid) - 1 AS idx FROM P WHERE dialect2 <> standard)
SELECT idx, sid, b_sid FROM ZA JOIN ZB USING (idx)"""
    q["pivot_pairs"] = w + P + """,
PB AS (SELECT standard, min(sid) AS sid2, arg_min(dialect2, sid) AS d2 FROM P WHERE dialect2 <> standard GROUP BY standard)
SELECT sid AS sid1, coalesce(sid2, -1) AS sid2, dialect AS d1, coalesce(d2, '') AS d2, sid2 IS NOT NULL AS matched
FROM P LEFT JOIN PB USING (standard) WHERE dialect <> standard"""
    lex = _lexicon_pw()
    q["learn_lexicon"] = lex + "\nSELECT region, e, f, round(p, 6) AS p FROM T2"
    q["align"] = lex + """,
AP AS (SELECT T2CE.region, u, f, e, ce, coalesce(T2.p, 0) AS p, sum(ce * coalesce(T2.p, 0)) OVER (PARTITION BY u, f) AS z
       FROM T2CE LEFT JOIN T2 USING (region, e, f) WHERE e <> '<null>'),
AQ AS (SELECT u, f, ce, p / z AS p, (list_position(s, e) - 2)::BIGINT AS s_pos FROM AP JOIN T2U USING (u) WHERE p > 0),
AG AS (SELECT u, f, sum(ce)::BIGINT AS sources, round(sum(ce * p), 6) AS sum_p, round(sum(ce * p * p), 6) AS sum_p2,
         arg_min(s_pos, (-round(p, 6), s_pos)) AS s_pos, max(round(p, 6)) AS p FROM AQ GROUP BY u, f),
TP AS (SELECT u, unnest(t) AS f, unnest(range(len(t))) AS t_pos FROM T2U)
SELECT T2B.region, sid, sent, t_pos, sources, sum_p, sum_p2, s_pos, p
FROM T2B JOIN T2U USING (region, s, t) JOIN TP USING (u) JOIN AG USING (u, f)"""
    tr = lex + ",\n" + best("T2", "BT") + ",\n" + translate_cte("PW", "dw", "BT", "TR")
    q["translate"] = tr + "\nSELECT region, sid, inference FROM TR"
    q["write_inference_log"] = tr + """
SELECT row_number() OVER (ORDER BY PW.sid) AS id, PW.dialect AS standard, PW.standard AS dialect, TR.inference,
       'lexicon' AS model, 'word' AS level, 'dia2std' AS direction
FROM PW JOIN TR USING (region, sid)"""
    q["translate_bleu"] = tr + """,
BS AS (SELECT PW.sid, PW.region, PW.sw AS r, """ + words("TR.inference") + """ AS h FROM PW JOIN TR USING (region, sid)),
""" + bleu_ctes("BS") + """
SELECT region, """ + bleu_round() + """ FROM (SELECT BS.region, avg(bleu1) AS bleu1, avg(bleu2) AS bleu2,
   avg(bleu3) AS bleu3, avg(bleu4) AS bleu4 FROM BL JOIN BS USING (sid) GROUP BY BS.region)"""
    mix = lex + """,
BP AS (SELECT region, e, arg_min(f, (-round(p, 6), f)) AS token, max(round(p, 6)) AS p FROM T2 GROUP BY region, e),
GEN AS (SELECT DISTINCT u, token, ln(p) AS score FROM (SELECT DISTINCT region, u, unnest(s[2:]) AS e FROM T2U) JOIN BP USING (region, e)
        WHERE p > 0),
GX AS (SELECT u, token, max(score) AS score FROM GEN GROUP BY u, token),
AP AS (SELECT T2CE.region, u, f, e, ce, coalesce(T2.p, 0) AS p, sum(ce * coalesce(T2.p, 0)) OVER (PARTITION BY u, f) AS z
       FROM T2CE LEFT JOIN T2 USING (region, e, f) WHERE e <> '<null>'),
AE AS (SELECT u, e, any_value(ce) AS ce, sum(cf * p / z) / any_value(nt) AS score FROM AP JOIN T2FS USING (u, f) WHERE p > 0 GROUP BY u, e),
CS AS (SELECT u, e AS token, ce * score AS score FROM AE),
AL AS (SELECT u, token, score FROM GX UNION ALL SELECT u, token, score FROM CS),
EX AS (SELECT u, token, exp(score - max(score) OVER (PARTITION BY u)) AS x FROM AL),
PR AS (SELECT u, token, x / sum(x) OVER (PARTITION BY u) AS prob FROM EX),
PT AS (SELECT u, token, ln(sum(prob) + 1e-10) AS logp FROM PR GROUP BY u, token),
TOP AS (SELECT u, arg_min(token, (-round(logp, 6), token)) AS token, max(round(logp, 6)) AS logp FROM PT GROUP BY u)"""
    q["copy_generate_mix"] = mix + """
SELECT sid, sent, token, logp FROM T2B JOIN T2U USING (region, s, t) JOIN TOP USING (u)"""
    q["selective_read"] = mix + """,
SP AS (SELECT u, unnest(s[2:]) AS e, unnest(range(len(s) - 1)) AS s_pos FROM T2U),
SEL AS (SELECT u, s_pos, score FROM SP JOIN AE USING (u, e) JOIN TOP ON TOP.u = SP.u AND TOP.token = SP.e),
WT AS (SELECT u, s_pos, score / greatest(sum(abs(score)) OVER (PARTITION BY u), 1e-12) AS w FROM SEL),
TF AS (SELECT u, f, e, p / z AS p FROM AP WHERE p > 0),
TV AS (SELECT WT.u, f, sum(w * p) AS value FROM WT JOIN SP ON SP.u = WT.u AND SP.s_pos = WT.s_pos JOIN TF ON TF.u = SP.u AND TF.e = SP.e GROUP BY WT.u, f),
TP AS (SELECT u, unnest(t) AS f, unnest(range(len(t))) AS dim FROM T2U),
TE AS (SELECT DISTINCT u, f FROM TF)
SELECT sid, sent, dim, round(coalesce(value, 0), 6) AS value FROM T2B JOIN T2U USING (region, s, t) JOIN TP USING (u) JOIN TE USING (u, f)
LEFT JOIN TV USING (u, f)"""
    two = "WITH " + SW + ",\n" + em("dw", "sw", "L1") + ",\n" + em("sw", "d2w", "L2")
    q["pivot_translate"] = two + ",\n" + best("L1", "B1") + ",\n" + best("L2", "B2") + ",\n" \
        + translate_cte("PW", "dw", "B1", "M1") + f""",
MC AS (SELECT region, sid, CASE WHEN strpos(inference, '<') > 0 THEN regexp_replace(substring(inference, 1, strpos(inference, '<') - 1),
        '^[{SPACE}]+|[{SPACE}]+$', '', 'g') ELSE inference END AS middle FROM M1),
MW AS (SELECT region, sid, middle, {words('middle')} AS mw FROM MC),
""" + translate_cte("MW", "mw", "B2", "M2") + """
SELECT MW.region, MW.sid, MW.middle, M2.inference FROM MW JOIN M2 USING (region, sid)"""
    q["compose_lexicons"] = two + """,
CP AS (SELECT a.region, a.e, b.f, sum(a.p * b.p) AS p FROM L1 a JOIN L2 b ON a.region = b.region AND a.f = b.e
       WHERE a.p >= {COMPOSE_MIN_P} AND b.p >= {COMPOSE_MIN_P} GROUP BY a.region, a.e, b.f)
SELECT region, e, arg_min(f, (-round(p, 6), f)) AS f, max(round(p, 6)) AS p, count(*) AS targets,
  round(sum(p), 6) AS sum_p, round(sum(p * p), 6) AS sum_p2 FROM CP GROUP BY region, e"""
    loss = lex + ",\n" + losses("T2", "T2", "NL")
    q["nll"] = loss + "\nSELECT region, round(train_loss, 6) AS loss FROM NL"
    q["perplexity"] = loss + """
SELECT region, round(train_loss, 6) AS loss, round(exp(train_loss), 6) AS ppl, floor(exp(train_loss))::BIGINT AS ppl_int FROM NL"""
    parts = "WITH " + SW + """,
LI AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS i FROM P),
LN AS (SELECT count(*) AS n FROM P),
SR AS (SELECT SW.* EXCLUDE (k, h), (i < n * 9 // 10)::INT AS k, (i >= n * 9 // 10 AND i < n * 95 // 100)::INT AS h
       FROM SW JOIN LI USING (sid), LN WHERE i < n * 95 // 100)"""
    q["learn_history"] = parts + ",\n" + em("dw", "sw", "H", HISTORY_EPOCHS, "SR") + "".join(
        ",\n" + losses("H", f"HT{r}", f"HL{r}") for r in range(1, HISTORY_EPOCHS + 1)) + """,
EL AS (""" + " UNION ALL ".join(f"SELECT region AS run, {r - 1} AS epoch, train_loss, valid_loss FROM HL{r}" for r in range(1, HISTORY_EPOCHS + 1)) + "),\n" \
        + streak("EL", "valid_loss", "SV", "streak_v") + ",\n" + streak("SV", "train_loss", "ST", "streak_t") + """,
SE AS (SELECT *, min(CASE WHEN floor(exp(valid_loss)) > 20000 OR streak_v > 3 OR streak_t > 3 THEN epoch END) OVER (PARTITION BY run) AS stop FROM ST),
BS AS (SELECT *, coalesce(valid_loss < min(valid_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
       FROM SE WHERE stop IS NULL OR epoch <= stop),
BE AS (SELECT run, max(epoch) AS best FROM BS WHERE is_best GROUP BY run),
TT AS (""" + " UNION ALL ".join(f"SELECT region AS run, {r - 1} AS epoch, count(*) AS n, sum(p * p) AS s FROM HT{r} GROUP BY region" for r in range(1, HISTORY_EPOCHS + 1)) + """)
SELECT BS.run, BS.epoch::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(valid_loss, 6) AS valid_loss, is_best, streak_v, streak_t,
  coalesce(n, 0)::BIGINT AS table_rows, round(coalesce(s, 0), 4) AS table_p2
FROM BS JOIN BE ON BE.run = BS.run LEFT JOIN TT ON TT.run = BS.run AND TT.epoch = BS.epoch AND BS.epoch = best"""
    q["continue_lexicon"] = parts + """,
S1 AS (SELECT * FROM SR WHERE k = 1),
S2 AS (SELECT * EXCLUDE (k, h), 1 AS k, 0 AS h FROM SR WHERE h = 1),
""" + em("dw", "sw", "A", 2, "S1") + ",\n" + em("dw", "sw", "B", 2, "S2", "A") + "\nSELECT region, e, f, round(p, 6) AS p FROM B"
    # evaluation
    bl = w + PW + ",\nBS AS (SELECT sid, region, sw AS r, dw AS h FROM PW),\n" + bleu_ctes("BS")
    q["ngram_matches"] = bl + """,
GRID AS (SELECT sid, unnest([1, 2, 3, 4]) AS n FROM BS)
SELECT GRID.sid, GRID.n, coalesce(MM.m, 0)::BIGINT AS matches, coalesce(MM.t, 0)::BIGINT AS total
FROM GRID LEFT JOIN MM USING (sid, n)"""
    q["sentence_bleu"] = bl + "\nSELECT sid, " + bleu_round() + " FROM BL"
    q["corpus_bleu_mean"] = bl + "\nSELECT region, " + bleu_round() + """ FROM (
  SELECT BS.region, avg(bleu1) AS bleu1, avg(bleu2) AS bleu2, avg(bleu3) AS bleu3, avg(bleu4) AS bleu4
  FROM BL JOIN BS USING (sid) GROUP BY BS.region)"""
    q["corpus_bleu_conv"] = f"""WITH CV AS (SELECT conv_id, turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
  FROM conversations),
BS AS (SELECT conv_id * {STRIDE} + turn AS sid, {words('text')} AS r, {words('ntext')} AS h FROM CV
       WHERE role = 'user' AND nrole = 'assistant'),
""" + bleu_ctes("BS") + "\nSELECT " + bleu_round() + """ FROM (SELECT coalesce(avg(bleu1), 0) AS bleu1,
  coalesce(avg(bleu2), 0) AS bleu2, coalesce(avg(bleu3), 0) AS bleu3, coalesce(avg(bleu4), 0) AS bleu4 FROM BL)"""
    q["corpus_stats"] = w + CLEAN + ",\n" + split + """,
SP AS (SELECT C.*, CASE WHEN i < n * 9 // 10 THEN 'train' WHEN i < n * 95 // 100 THEN 'valid' ELSE 'test' END AS split
       FROM C JOIN CI USING (sid))
SELECT split, count(*) AS n_rows, max(length(standard)) AS max_chars, max(len(""" + words("standard") + """)) AS max_words
FROM SP GROUP BY split"""
    q["length_histogram"] = w + PW + """,
HA AS (SELECT len(sw) AS n_words, count(*) AS n_standard FROM PW GROUP BY 1),
HB AS (SELECT len(dw) AS n_words, count(*) AS n_dialect FROM PW GROUP BY 1)
SELECT coalesce(HA.n_words, HB.n_words) AS n_words, coalesce(n_standard, 0) AS n_standard, coalesce(n_dialect, 0) AS n_dialect
FROM HA FULL OUTER JOIN HB ON HA.n_words = HB.n_words"""
    q["token_freq"] = w + PW + "\nSELECT token, count(*) AS freq FROM (SELECT unnest(sw) AS token FROM PW) GROUP BY token"
    # epochs
    q["best_so_far"] = w + EPOCHS + """
SELECT run, epoch, min(valid_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss,
  coalesce(valid_loss < min(valid_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
FROM EL"""
    streaks = w + EPOCHS + ",\n" + streak("EL", "valid_loss", "SV", "streak_v") + ",\n" + streak("SV", "train_loss", "ST", "streak_t")
    q["increase_streak"] = streaks + "\nSELECT run, epoch, streak_v, streak_t FROM ST"
    q["stop_epoch"] = streaks + """
SELECT run, count(CASE WHEN stop_epoch IS NULL OR epoch <= stop_epoch THEN 1 END) AS epochs_run,
       stop_epoch IS NOT NULL AS stopped
FROM (SELECT run, epoch, min(CASE WHEN floor(exp(valid_loss)) > 20000 OR streak_v > 3 OR streak_t > 3 THEN epoch END)
        OVER (PARTITION BY run) AS stop_epoch FROM ST) GROUP BY run, stop_epoch"""
    q["elapsed"] = w + EPOCHS + """,
US AS (SELECT run, epoch, datediff('microsecond', start_ts, end_ts) AS us FROM EL)
SELECT run, epoch, (us // 60000000)::BIGINT AS elapsed_mins, ((us - (us // 60000000) * 60000000) // 1000000)::BIGINT AS elapsed_secs FROM US"""
    return {k: v.replace("{STRIDE}", str(STRIDE)).replace("{COMPOSE_MIN_P}", str(COMPOSE_MIN_P)) for k, v in q.items()}


ORACLE = build()
