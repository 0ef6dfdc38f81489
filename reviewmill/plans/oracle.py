"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from reviewmill.functions.lexicon import (DOMAIN_ASPECTS, DOMAIN_KEYWORDS, ERROR_MARK, GENERIC_QUERY,
                                          CATEGORY_COLUMN_NAMES, INDONESIAN_KEYWORDS, NO_REVIEWS_REPORT,
                                          PRODUCT_COLUMN_NAMES, RATING_COLUMN_NAMES, REFINE_SUFFIX,
                                          REPORT_SECTIONS, STOP_WORDS, TEXT_COLUMN_NAMES, WHITESPACE)

REVIEWS = """
select d.doc_id as review_id,
  concat(d.text, ' ', case d.doc_id % 12
    when 0 then 'The fabric of this dress is thin and the size does not fit'
    when 1 then 'The shirt is lovely to wear'
    when 2 then 'The sole is grippy and comfortable for running'
    when 3 then 'These shoes are tight and the sneaker broke'
    when 4 then 'The battery will not charge and the screen is dark'
    when 5 then 'Good sound but the button on the device is stuck'
    when 6 then 'bagus sekali mantap baju nya'
    when 7 then 'kecewa sepatu jelek kurang nyaman'
    when 8 then 'shipping was very late and the box was damaged'
    when 9 then 'customer service never answered'
    when 10 then 'great value for the price'
    else 'exactly as described' end) as review_text,
  case when d.doc_id % 17 = 0 then 'n/a'
       when d.doc_id % 23 = 0 then null
       else cast(case when l.quality = 1 then 3 + d.doc_id % 3
                      when l.quality = 0 then 1 + d.doc_id % 3
                      else 1 + d.doc_id % 5 end as varchar) end as rating,
  p.p_name as product_name,
  case when d.doc_id % 29 = 0 then null else d.source end as category,
  d.lang, l.quality as recommended,
  case when coalesce(l.toxic, d.doc_id % 3) = 0 then 1 else 0 end as predicted_ind,
  cast(0.5 as double) + cast(d.doc_id % 50 as double) / cast(100 as double) as confidence
from documents d
left join labels l on l.doc_id = d.doc_id
left join part p on p.p_partkey = d.doc_id % (select max(p_partkey) + 1 from part)
"""


def text_literal(value: str) -> str:
    if any(ord(c) < 32 for c in value):
        parts = [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in value]
        return "concat(" + ", ".join(parts) + ")"
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text_literal(v) for v in values) + "]"


def r6(expression: str, digits: int = 6) -> str:
    scale = f"1e{digits}::double"
    return f"floor(({expression}) * {scale} + 0.5) / {scale}"


SPACES = text_literal(WHITESPACE)


def number(column: str) -> str:
    stripped = f"trim({column}, {SPACES})"
    return (f"case when regexp_matches({stripped}, "
            r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') "
            f"then try_cast({stripped} as double) end")


PREDICTED = f"""
reviews as ({REVIEWS}),
rated as (select *, {number('rating')} as stars from reviews),
labelled as (select *, case when stars >= 4 then 1 when stars <= 2 then 0 end as label from rated),
corrected as (
  select * replace (cast(coalesce(label, predicted_ind) as integer) as predicted_ind),
    coalesce(label <> predicted_ind, false) as rule_corrected,
    predicted_ind as first_ind
  from labelled),
predictions as (
  select *, case predicted_ind when 0 then 'Negative' when 1 then 'Positive' else 'Unknown' end
    as predicted_sentiment,
    coalesce(cast(category as varchar), 'Unknown') as grp
  from corrected)
"""


def hits_of(words) -> str:
    return " + ".join(
        f"cast((length(t) - length(replace(t, '{w}', ''))) / {len(w)} as bigint)" for w in words)


HITS = ", ".join(f"{hits_of(words)} as {name}_hits" for name, words in
                 [*DOMAIN_KEYWORDS.items(), ("indonesian", INDONESIAN_KEYWORDS)])
ROUTE = """
case when greatest(clothing_hits, shoes_hits, electronics_hits) = 0 then 'general'
     when clothing_hits >= shoes_hits and clothing_hits >= electronics_hits then 'clothing'
     when shoes_hits >= electronics_hits then 'shoes' else 'electronics' end as domain,
case when indonesian_hits > clothing_hits + shoes_hits + electronics_hits
     then 'Indonesian' else 'English' end as language"""
SUMS = ", ".join(f"cast(coalesce(sum({n}_hits), 0) as bigint) as {n}_hits"
                 for n in [*DOMAIN_KEYWORDS, "indonesian"])
ROW_HITS = f"row_hits as (select review_id, {HITS} from (select *, lower(review_text) as t from reviews))"
DATASET_ROUTES = f"""
routes as (select grp, {SUMS} from (select grp, {HITS} from (
             select grp, lower(review_text) as t from predictions)) group by grp),
routed as (select *, {ROUTE} from routes)"""

WORDS = r"regexp_extract_all(lower(review_text), '[\p{L}\p{N}_]{2,}')"


def term_ctes(stop: bool, source: str = "reviews", extra: str = "") -> str:
    """CTEs n, postings(review_id, term, tf) of 1-2-grams."""
    words = f"list_filter({WORDS}, lambda x: x not in ({', '.join(map(text_literal, STOP_WORDS))}))" if stop else WORDS
    return f"""
words as (select review_id{extra}, {words} as w from {source}),
grams as (
  select review_id{extra}, unnest(w) as term from words
  union all
  select review_id{extra}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term
  from words where len(w) > 1),
postings as (select review_id{extra}, term, count(*) as tf from grams group by all),
n as (select count(*) as n from {source})"""


def weight_ctes(stop: bool, sublinear: bool, terms: str, source: str = "reviews", extra: str = "") -> str:
    tf = "(1 + ln(tf::double))" if sublinear else "tf::double"
    return f"""{term_ctes(stop, source, extra)},
terms as ({terms}),
raw as (select p.*, {tf} * (ln((1.0::double + n.n) / (1.0::double + t.df)) + 1) as w, t.df
        from postings p join terms t using (term), n),
weights as (select *, w / sqrt(sum(w * w) over (partition by review_id)) as weight from raw)"""


VOCABULARY = """select term, count(*) as df, cast(sum(tf) as bigint) as total from postings group by term
having count(*) >= {min_df} and count(*) <= 0.95::double * (select n from n)"""
TERMS = VOCABULARY.format(min_df=2)
TERMS_500 = f"select * from ({VOCABULARY.format(min_df=1)}) order by total desc, term limit 500"

CLUSTERED = f"""with reviews as ({REVIEWS}),
clustered as (select *, cast(review_id % 4 as integer) as cluster_id from reviews),
{weight_ctes(True, False, TERMS_500, 'clustered', ', cluster_id')},
sizes as (select cluster_id, count(*) as size from clustered group by 1),
centers as (select cluster_id, term, sum(weight) / any_value(size) as mean_weight
            from weights join sizes using (cluster_id) group by 1, 2),
keywords as (select cluster_id, cast(row_number() over (partition by cluster_id
               order by {r6('mean_weight', 9)} desc, term) as integer) as rank, term, mean_weight from centers),
lengths as (select cluster_id, sqrt(sum(mean_weight * mean_weight)) as len from centers group by 1),
near as (select cluster_id, review_id, sum(weight * mean_weight / len) as similarity
         from weights join centers using (cluster_id, term) join lengths using (cluster_id) group by 1, 2),
samples as (select cluster_id, cast(row_number() over (partition by cluster_id
              order by {r6('similarity', 9)} desc, review_id) as integer) as rank, review_id, similarity from near),
word_lists as (select cluster_id, list(term order by rank) as words from keywords where rank <= 5 group by 1)
"""

INDEX = """
vectors as (
  select vec_id as id, 'vector ' || vec_id as text,
    case label % 3 when 0 then 'Negative' when 1 then 'Positive' else 'Neutral' end as sentiment,
    cast(label % 5 + 1 as double) as rating, label, cast(embedding as double[]) as e from embeddings),
cells as (select label, unnest(e) as x, generate_subscripts(e, 1) as d from vectors),
sums as (select label, d, sum(x) as x from cells group by 1, 2),
asked as (select cast(label as bigint) as query_id, list(x order by d) as v, sqrt(sum(x * x)) as norm
          from sums group by label)"""


def topk(k: str, wanted: str, select: str = "query_id, rank, id, greatest(0, least(1, score)) as score") -> str:
    return f"""with {INDEX},
queries as (select *, {k} as k, {wanted} as wanted,
            {wanted} is not null and exists (select 1 from vectors x where x.sentiment = {wanted}) as has_match
            from asked),
scored as (select query_id, k, id, text, sentiment, rating,
             {r6('list_dot_product(e, v) / norm')} as score
           from vectors, queries where not has_match or sentiment = wanted),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank
           from scored)
select {select} from ranked where rank <= k"""


def percent(share: str) -> str:
    units = f"cast(floor(({share}) * 1000.0::double + 0.5) as bigint)"
    return f"concat({units} // 10, '.', {units} % 10, '%')"


COVERAGE = f"""
checked as (
  select review_id as report_id, category,
    case when review_id % 19 = 0 then concat('{ERROR_MARK}', review_text)
         when review_id % 23 = 0 then '' else review_text end as report,
    review_id % 31 = 0 or review_id % 19 = 0 as failed
  from reviews),
tested as (
  select *, [{', '.join('(' + ' or '.join(f"contains(lower(report), '{w}')" for w in words) + ')'
                        for words in DOMAIN_KEYWORDS.values())}] as found,
    failed or report = '' as nothing
  from checked),
covered as (
  select *, list_filter([0, 1, 2], lambda i: found[i + 1]) as hit, list_filter([0, 1, 2], lambda i: not found[i + 1]) as miss
  from tested)"""
FIRST_TWO = "[" + ", ".join(text_literal(" ".join(w[:2])) for w in DOMAIN_KEYWORDS.values()) + "]"

ASPECTS = "case domain " + " ".join(
    f"when '{d}' then {text_list(a)}" for d, a in DOMAIN_ASPECTS.items() if d != "general"
) + f" else {text_list(DOMAIN_ASPECTS['general'])} end"

GROUPS = f"""with {PREDICTED}, {DATASET_ROUTES},
negatives as (select grp, review_text, row_number() over (partition by grp order by review_id) as place
              from predictions where predicted_ind = 0),
chosen as (select grp, list(review_text order by place) as texts from negatives where place <= 20 group by 1),
counts as (select grp, count(*) filter (where rule_corrected) as corrections, count(*) as n_reviews
           from predictions group by 1),
groups as (select * exclude (texts), coalesce(texts, []) as texts
  from counts left join chosen using (grp) join routed using (grp))"""
LISTS = [list(w) for w in DOMAIN_KEYWORDS.values()]


def _prompt() -> str:
    lines = ", chr(10), ".join(
        f"'  • Cluster #{i} (', n_reviews + {i}, ' reviews): {', '.join(w[:3])}'" for i, w in enumerate(LISTS))
    retry = ", ".join(f"'{w[0]}'" for w in LISTS[1:])
    return f"""{GROUPS}
select grp, concat(
  'Write a business report on the complaints in these shop reviews.', chr(10),
  'Domain: ', upper(domain[1]), domain[2:], chr(10), 'Language: ', language, chr(10),
  case when language = 'Indonesian' then concat('The reviews are Indonesian: read them as they are, write in English and translate what you quote.', chr(10)) else '' end,
  case when corrections > 0 then concat('Star ratings overruled the model in ', corrections, ' predictions; the reviews below are negative by model and rating.', chr(10)) else '' end,
  'Themes found in these reviews, each of which the report must cover:', chr(10), {lines}, chr(10),
  {text_literal('Retry 1/2: the last report left out ' + retry + '. Cover them in all three sections.')}, chr(10),
  'Sort the complaints by aspect, such as:', chr(10),
  array_to_string(list_transform({ASPECTS}, lambda a: '  - ' || a), chr(10)), chr(10),
  'Name only aspects that the reviews show, and quote them briefly.', chr(10),
  'Answer in Markdown under exactly these headings:', chr(10),
  {', chr(10), '.join(text_literal(s) for s in REPORT_SECTIONS)}, chr(10),
  'with 2-3 sentences, `###` sub-headings with bullets, and 3-5 numbered actions.', chr(10),
  'Reviews:', chr(10), array_to_string(list_transform(texts, lambda x: '- ' || x), chr(10)), chr(10)) as prompt
from groups"""


def _template() -> str:
    named = ", chr(10), ".join(
        f"'### {w[0].capitalize()}', chr(10), '- ', n_reviews + {i}, ' reviews mention {', '.join(w)}'"
        for i, w in enumerate(LISTS))
    actions = ", chr(10), ".join(f"'{i + 1}. Look into {w[0]} and {w[1]}'" for i, w in enumerate(LISTS))
    s = [text_literal(x) for x in REPORT_SECTIONS]
    return f"""{GROUPS}
select grp, case when len(texts) = 0 then {text_literal(NO_REVIEWS_REPORT)}
  else concat({s[0]}, chr(10), len(texts), ' negative reviews in 3 themes.', chr(10),
  {s[1]}, chr(10), {named}, chr(10), {s[2]}, chr(10), {actions}, chr(10)) end as report
from groups"""


PROFILE_COLUMNS = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "reviews": ["review_id", "review_text", "rating", "product_name", "category", "lang",
                "recommended", "predicted_ind"],
}
PROFILE = f"reviews as ({REVIEWS}), profile as (" + " union all ".join(
    f"select '{t}' as table_name, {i} as ordinal, '{c}' as name, count({c}) as non_null, "
    f"avg(length(cast({c} as varchar))) as mean_len, "
    f"cast(count({number(f'cast({c} as varchar)')}) as double) / nullif(count({c}), 0) as numeric_share from {t}"
    for t, cols in PROFILE_COLUMNS.items() for i, c in enumerate(cols)) + ")"


def _candidates(role: str, names: list[str]) -> str:
    return ", ".join(f"('{role}', {i}, '{n}')" for i, n in enumerate(names))


ROLES = f"""with {PROFILE},
candidates(role, priority, candidate) as (values {_candidates('text', TEXT_COLUMN_NAMES)},
  {_candidates('rating', RATING_COLUMN_NAMES)}, {_candidates('product', PRODUCT_COLUMN_NAMES)},
  {_candidates('category', CATEGORY_COLUMN_NAMES)}),
matched as (select *, case when lower(name) = candidate then 0 else 1 end as step
            from profile join candidates on contains(lower(name), candidate)),
ranked as (select table_name, role, name, row_number() over (partition by table_name, role order by
             case when role = 'text' then step else 0 end, case when role = 'text' then priority else 0 end,
             ordinal) as place
           from matched where role <> 'text' or step = 0 or mean_len >= 10),
longest as (select table_name, name, row_number() over (partition by table_name
              order by mean_len desc, ordinal) as place from profile where mean_len > 0)
select table_name, role, name from ranked where place = 1
union all select table_name, 'longest', name from longest where place = 1"""

SAMPLE_KEY = "md5(concat('42:', review_id))"

KEYWORDS = ["late", " Fabric ", "battery", "kurang", "the size", "a_b%", "the"]

CSV = """with kinds(kind) as (values ('comma'), ('semicolon'), ('tab'), ('pipe'))"""

FIELDS = ", ".join(
    f"case when {c} is null then '-' else concat(octet_length(encode({c})), ':', {c}) end"
    for c in ("cast(review_id as varchar)", "review_text", "rating", "category"))

ORACLE: dict[str, str] = {
    "clean_text": f"""with reviews as ({REVIEWS})
        select review_id, trim(coalesce(category, ''), {SPACES}) as category_text,
          trim(coalesce(category, ''), {SPACES}) <> '' as has_category,
          length(trim(review_text, {SPACES})) as n_chars from reviews""",
    "numeric_rating": f"with {PREDICTED} select review_id, stars as rating_value from rated",
    "label_from_rating": f"""with {PREDICTED} select review_id, label, length(review_text) as n_chars
        from labelled where label is not null and trim(review_text, {SPACES}) <> ''""",
    "base_training_rows": f"""with reviews as ({REVIEWS}) select review_id, recommended,
        length(review_text) as n_chars from reviews where recommended in (0, 1)""",
    "rule_correction": f"""with {PREDICTED} select review_id, predicted_ind as "Predicted_IND",
        predicted_sentiment as "Predicted_Sentiment", confidence as "Confidence",
        rule_corrected as "Rule_Corrected" from predictions""",
    "prediction_columns": f"""with reviews as ({REVIEWS}),
        p as (select review_id, case when predicted_ind = 1 then confidence
                else 1 - confidence end as p from reviews)
        select review_id, case when p > 0.5 then 1 else 0 end as "Predicted_IND",
          case when p > 0.5 then 'Positive' else 'Negative' end as "Predicted_Sentiment",
          {r6('greatest(p, 1 - p)', 4)} as "Confidence", {percent('greatest(p, 1 - p)')} as "Confidence_Pct"
        from p""",
    "keyword_hits": f"with reviews as ({REVIEWS}), {ROW_HITS} select * from row_hits",
    "domain_language_row": f"with reviews as ({REVIEWS}), {ROW_HITS} select *, {ROUTE} from row_hits",
    "domain_language_table": f"""with reviews as ({REVIEWS}),
        first as (select *, lower(review_text) as t from reviews),
        totals as (select {SUMS} from (select {HITS} from first)) select *, {ROUTE} from totals""",
    "domain_language_dataset": f"""with {PREDICTED}, {DATASET_ROUTES}
        select grp as dataset, * exclude (grp) from routed""",
    "column_profile": f"""with {PROFILE} select table_name, ordinal, name, non_null,
        {r6('mean_len')} as mean_len, {r6('numeric_share')} as numeric_share from profile""",
    "column_roles": ROLES,
    "sentiment_distribution": f"""with {PREDICTED} select predicted_sentiment as sentiment, count(*) as n,
        {r6('count(*)::double / sum(count(*)) over ()')} as share from predictions group by 1""",
    "confidence_summary": f"""with {PREDICTED} select {r6('avg(confidence)')} as avg_confidence,
        count(*) filter (where confidence < 0.6::double) as low_confidence from predictions""",
    "correction_count": f"""with {PREDICTED} select count(*) filter (where rule_corrected) as corrected
        from predictions""",
    "top_products": f"""with {PREDICTED} select coalesce(product_name, 'Unknown') as product, count(*) as n
        from predictions where predicted_ind = 1 group by 1 order by n desc, product limit 5""",
    "red_flag_categories": f"""with {PREDICTED} select grp as category, count(*) as n,
        {r6('count(*)::double / sum(count(*)) over ()')} as share
        from predictions where predicted_ind = 0 group by 1""",
    "sentiment_filter": f"""with {PREDICTED} select review_id, predicted_sentiment as "Predicted_Sentiment",
        predicted_ind as "Predicted_IND" from predictions where predicted_sentiment = 'Negative'""",
    "explore_rows": f"""with {PREDICTED} select review_id, predicted_sentiment as "Predicted_Sentiment",
        predicted_ind as "Predicted_IND", length(review_text) as n_chars, category from predictions
        where predicted_sentiment = 'Negative' and contains(lower(review_text), 'late')""",
    "filtered_count": f"""with {PREDICTED} select count(*) filter (where predicted_sentiment = 'Positive'
        and contains(lower(review_text), 'size')) as shown, count(*) as total from predictions""",
    "keyword_filter": f"with reviews as ({REVIEWS}) " + " union all ".join(
        f"select '{k.strip().lower()}' as keyword, count(*) filter (where contains(lower(review_text), "
        f"'{k.strip().lower()}')) as n from reviews" for k in KEYWORDS),
    "keyword_table": f"""with reviews as ({REVIEWS}),
        words as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}'))) as keyword from benchmark)
        select keyword, count(*) as n, min(review_id) as first_id from words
        join reviews on contains(lower(review_text), keyword) group by 1""",
    "negative_sample": f"""with {PREDICTED} select review_id, length(review_text) as n_chars
        from predictions where predicted_ind = 0 and trim(review_text, {SPACES}) <> ''
        order by {SAMPLE_KEY}, review_id limit 15""",
    "index_cap_sample": f"""with reviews as ({REVIEWS}) select review_id, rating from reviews
        order by {SAMPLE_KEY}, review_id limit 150""",
    "class_balance": f"""with {PREDICTED} select count(label) as n, count(*) filter (where label = 0) as negative,
        count(*) filter (where label = 1) as positive,
        count(label) >= 20 and count(*) filter (where label = 0) >= 2
          and count(*) filter (where label = 1) >= 2 as trainable from labelled""",
    "model_choice": f"""with {PREDICTED}, usable as (select grp, case when trim(review_text, {SPACES}) <> ''
          then label end as label from predictions)
        select grp as dataset, count(label) as n, count(*) filter (where label = 0) as negative,
          count(*) filter (where label = 1) as positive,
          case when count(label) >= 20 and count(*) filter (where label = 0) >= 2
            and count(*) filter (where label = 1) >= 2 then 'dataset' else 'base' end as model
        from usable group by 1""",
    "model_used": f"""with {PREDICTED}, usable as (select grp, case when trim(review_text, {SPACES}) <> ''
          then label end as label from predictions)
        select grp as dataset, case when count(label) >= 20 and count(*) filter (where label = 0) >= 2
            and count(*) filter (where label = 1) >= 2 then 'dataset' else 'base' end as model, count(*) as n
        from usable group by 1""",
    "confusion": f"""with {PREDICTED} select label, predicted_ind as prediction, count(*) as n
        from labelled where label is not null group by 1, 2""",
    "class_report": f"""with {PREDICTED},
        cells as (select c, count(*) filter (where label = c and predicted_ind = c) as hit,
                    count(*) filter (where predicted_ind = c) as said, count(*) filter (where label = c) as support
                  from labelled, (values (0), (1)) as classes(c) where label is not null group by c),
        rates as (select *, coalesce(hit::double / nullif(said, 0), 0) as p,
                    coalesce(hit::double / nullif(support, 0), 0) as r from cells),
        scores as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from rates),
        report as (
          select case c when 0 then 'Negative' else 'Positive' end as class, p, r, f, support from scores
          union all select 'accuracy', a, a, a, s from (select sum(hit)::double / sum(support) as a,
            sum(support) as s from scores)
          union all select 'macro avg', avg(p), avg(r), avg(f), sum(support) from scores
          union all select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
            sum(f * support) / sum(support), sum(support) from scores)
        select class, {r6('p')} as "precision", {r6('r')} as recall, {r6('f')} as f1,
          cast(support as bigint) as support from report""",
    "stratified_split": f"""with {PREDICTED} select review_id, label,
        row_number() over same < ceil(0.2 * count(*) over (partition by label)) as is_test
        from labelled where label is not null
        window same as (partition by label order by substr({SAMPLE_KEY}, 1, 8))""",
    "class_weights": f"""with {PREDICTED}, counts as (select label, count(*) as n from labelled
          where label is not null group by 1)
        select label, n, {r6('(select sum(n)::double / count(*) from counts) / n')} as weight from counts""",
    "tokens": f"""with reviews as ({REVIEWS}) select term, count(*) as n
        from (select unnest({WORDS}) as term from reviews) group by 1""",
    "stop_word_removal": f"""with reviews as ({REVIEWS}) select term, count(*) as n
        from (select unnest({WORDS}) as term from reviews)
        where term not in ({', '.join(map(text_literal, STOP_WORDS))}) group by 1""",
    "ngrams": f"""with reviews as ({REVIEWS}), {term_ctes(True)}
        select term, count(*) as n from grams group by 1""",
    "vocabulary": f"with reviews as ({REVIEWS}), {term_ctes(True)} {TERMS}",
    "top_vocabulary": f"with reviews as ({REVIEWS}), {term_ctes(True)} {TERMS_500}",
    "tfidf_weights": f"""with reviews as ({REVIEWS}), {weight_ctes(False, True, TERMS)}
        select review_id, term, {r6('weight')} as weight from weights""",
    "feature_vectors": f"""with reviews as ({REVIEWS}), {weight_ctes(True, True, TERMS)},
        found as (select review_id, count(*) as k from weights group by 1)
        select review_id, cast((select count(*) from terms) as integer) as width,
          cast(coalesce(k, 0) as integer) as n_terms,
          case when k is null then 0.0::double else 1.0::double end as squared_norm
        from reviews left join found using (review_id)""",
    "linear_score": f"""with reviews as ({REVIEWS}), {weight_ctes(False, True, TERMS)},
        margins as (select review_id, sum(weight * ((length(term) % 7 - 3)::double / 10.0::double)) as m
                    from weights group by 1)
        select review_id, {r6('1 / (1 + exp(-(coalesce(m, 0) + 0.1::double)))')} as probability
        from reviews left join margins using (review_id)""",
    "l2_normalise": f"""with scaled as (select vec_id,
          list_transform(cast(embedding as double[]), lambda x: x * label) as v from embeddings),
        norms as (select *, sqrt(list_dot_product(v, v)) as norm from scaled),
        units as (select *, list_transform(v, lambda x: x / case when norm < 1e-12 then 1 else norm end) as u from norms)
        select vec_id, {r6('norm')} as norm, {r6('sqrt(list_dot_product(u, u))')} as unit_norm,
          {r6('u[1]')} as first_value from units""",
    "clamp_score": f"""select vec_id, {r6('greatest(0, least(1, embedding[1]::double * 8))')} as score
        from embeddings""",
    "vector_topk": topk("10", "cast(null as varchar)"),
    "vector_topk_filtered": topk("10", "case when query_id % 2 = 0 then 'Negative' else 'Positive' end"),
    "filter_fallback": topk("7", "case when query_id % 2 = 0 then 'Mixed' else 'Negative' end"),
    "widening_topk": topk("5 + 5 * (query_id % 3)", "cast(null as varchar)"),
    "vector_topk_grouped": topk("10", "cast(null as varchar)"),
    "string_id_search": topk("5", "'Positive'", """concat('label_', query_id) as query_id, rank,
        concat('row_', lpad(cast(id as varchar), 12, '0')) as id, sentiment, rating"""),
    "search_results": topk("5", "'Positive'", f"""query_id, rank, id,
        {percent('greatest(0, least(1, score))')} as "match", sentiment, rating, text"""),
    "index_table": f"""with {PREDICTED} select review_id as id, predicted_sentiment as sentiment,
        stars as rating, length(review_text) as n_chars from predictions
        where trim(review_text, {SPACES}) <> ''""",
    "index_reuse": f"""with reviews as ({REVIEWS}) select count(*) as n,
        cast(sum(length(review_text)) as bigint) as n_chars, false as reused_first, true as reused_second,
        false as reused_changed from reviews where trim(review_text, {SPACES}) <> ''""",
    "fingerprint": f"""with reviews as ({REVIEWS}),
        first as (select review_id, review_text from reviews order by review_id limit 100)
        select md5(concat('review_text:', (select count(*) from reviews), ':',
          string_agg(review_text, '||' order by review_id))) as fingerprint from first""",
    "full_fingerprint": f"""with reviews as ({REVIEWS}) select count(*) as n,
        cast(coalesce(sum(cast('0x' || substr(md5(row), 1, 15) as bigint)), 0) as varchar) as digest_a,
        cast(coalesce(sum(cast('0x' || substr(md5(row), 17, 15) as bigint)), 0) as varchar) as digest_b
        from (select concat({FIELDS}) as row from reviews)""",
    "index_upkeep": f"""with {PREDICTED}, parts as (select review_id, review_id % 3 as part, review_text, predicted_sentiment
          from predictions where trim(review_text, {SPACES}) <> ''),
        steps(step, upto) as (values ('built', 1), ('appended', 2), ('again', 2))
        select step, cast(count(*) filter (where part < upto or (upto = 2 and part = 0)) as bigint) as n,
          cast(case step when 'built' then count(*) filter (where part = 0)
            when 'appended' then count(*) filter (where part = 1) else 0 end as bigint) as embedded
        from parts, steps group by step""",
    "csv_scan_info": f"""{CSV} select kind, 'utf-8-sig' as encoding, kind as delimiter,
        cast(count(*) filter (where doc_id % 10 <> 3) as bigint) as rows,
        cast(count(*) filter (where doc_id % 10 = 3) as bigint) as rows_skipped, cast(0 as bigint) as errors
        from documents, kinds group by 1""",
    "csv_scan_rows": f"""{CSV} select kind, doc_id as id, length(text) as n_chars,
        case when doc_id % 10 <> 7 then source end as source, 3 as n_columns
        from documents, kinds where doc_id % 10 <> 3""",
    "csv_encodings": """with kinds(kind, encoding, ending, latin) as (values ('utf-8', 'utf-8-sig', ' \u20ac', false),
          ('cp1252', 'cp1252', ' \u00e9', true), ('latin-1', 'latin-1', ' ' || chr(129), true))
        select kind, encoding, cast(null as varchar) as error, doc_id as id, md5(case when latin
          then regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') else text end || ending) as text_md5
        from documents, kinds where text is not null""",
    "csv_unusable_files": """select 'full' as kind, 'comma' as delimiter, cast(null as varchar) as error,
          cast(count(*) filter (where doc_id % 10 <> 3) as bigint) as rows from documents
        union all select 'blank', 'comma', 'The file holds no text.', 0
        union all select 'header', 'comma', 'No row of the file could be used.', 0""",
    "prediction_export": f"""with {PREDICTED} select predicted_sentiment as "Predicted_Sentiment",
        cast(rule_corrected as varchar) as "Rule_Corrected", count(*) as n,
        cast(sum(length(review_text)) as bigint) as n_chars from predictions group by 1, 2""",
    "aspect_cluster_check": f"""with {PREDICTED} select count(*) as n, 4 as k, cast(0 as bigint) as misplaced
        from predictions where predicted_ind = 0 and trim(review_text, {SPACES}) <> ''""",
    "cluster_keywords": f"""{CLUSTERED} select cluster_id, rank, term, {r6('mean_weight')} as mean_weight
        from keywords where rank <= 5""",
    "cluster_representatives": f"""{CLUSTERED} select cluster_id, rank, review_id,
        {r6('similarity')} as similarity from samples where rank <= 3""",
    "round_robin_sample": f"""with reviews as ({REVIEWS}),
        c as (select review_id, cast(review_id % 4 as integer) as cluster_id from reviews),
        t as (select *, cast(row_number() over (partition by cluster_id order by review_id) as integer) as turn,
                count(*) over (partition by cluster_id) as size from c)
        select turn, review_id, cluster_id from t order by turn, size desc, cluster_id limit 30""",
    "cluster_table": f"""{CLUSTERED}, texts as (select s.cluster_id,
          string_agg(trim(review_text, {SPACES}), '|' order by rank) as x
          from samples s join reviews using (review_id) where rank <= 3 group by 1)
        select cluster_id, size, array_to_string(words, '|') as keywords, md5(x) as samples_digest
        from sizes join word_lists using (cluster_id) join texts using (cluster_id)""",
    "cluster_summary": f"""{CLUSTERED} select cluster_id,
        concat('#', cluster_id, '(', size, '): ', array_to_string(words[1:3], ', ')) as line
        from sizes join word_lists using (cluster_id)""",
    "query_normalise": f"""with topics as (select item_id,
          case when item_id % 5 = 0 then '' else trim(text, {SPACES}) end as t from benchmark)
        select item_id, case when t = '' then '{GENERIC_QUERY}' else t end as query,
          t as original_query, t = '' as is_generic from topics""",
    "report_coverage": f"""with reviews as ({REVIEWS}), {COVERAGE}
        select report_id, nothing or len(miss) = 0 as is_valid,
          {r6('case when failed then 0 when nothing then 1 else len(hit) / 3.0::double end')} as coverage_pct,
          case when nothing then '' else array_to_string(hit, ',') end as covered,
          case when nothing then '' else array_to_string(miss, ',') end as missed from covered""",
    "refine_query": f"""with reviews as ({REVIEWS}), {COVERAGE}
        select report_id, trim(case when nothing or len(miss) = 0
          then concat(coalesce(category, ''), ' {GENERIC_QUERY}')
          else concat_ws(' ', coalesce(category, ''),
            array_to_string(list_transform(miss, lambda i: {FIRST_TWO}[i + 1]), ' '), '{REFINE_SUFFIX}') end) as query
        from covered""",
    "keep_looping": f"""with reviews as ({REVIEWS}), {COVERAGE}
        select report_id, cast(report_id % 4 as integer) as round,
          not (nothing or len(miss) = 0) and report_id % 4 < 2 as again from covered""",
    "domain_aspects": f"""with reviews as ({REVIEWS}), {ROW_HITS},
        routed as (select review_id, {ROUTE} from row_hits)
        select review_id, array_to_string({ASPECTS}, '|') as aspects from routed""",
    "prompt_table": _prompt(),
    "template_report": _template(),
    "step_log": f"""with {PREDICTED}, g as (select grp, count(*) as n,
          count(*) filter (where rule_corrected) as k from predictions group by 1)
        select grp, 0 as position, 'retrieve' as step, concat(n, ' reviews') as info from g
        union all select grp, 1, 'check report', concat(k, ' corrected') from g""",
}
