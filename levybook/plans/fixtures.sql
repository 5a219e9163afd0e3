-- Fixture views, in order of creation.  Same text for Spark and for the oracle.

-- view: jurisdiction
SELECT lpad(CAST(n_nationkey+1 AS STRING),2,'0') AS geoid,'state' AS kind,n_name AS name,lpad(CAST(n_nationkey+1 AS STRING),2,'0') AS state_usps,CAST(NULL AS BIGINT) AS population FROM nation
UNION ALL SELECT lpad(CAST(s_nationkey+1 AS STRING),2,'0')||lpad(CAST(s_suppkey AS STRING),5,'0'),'county',s_name||' County',lpad(CAST(s_nationkey+1 AS STRING),2,'0'),CAST(floor(abs(s_acctbal)*100) AS BIGINT) FROM supplier
UNION ALL SELECT lpad(CAST(c_nationkey+1 AS STRING),2,'0')||lpad(CAST(c_custkey AS STRING),7,'0'),'place',c_name||' city',lpad(CAST(c_nationkey+1 AS STRING),2,'0'),CASE WHEN c_acctbal<0 THEN NULL ELSE CAST(floor(c_acctbal*10) AS BIGINT) END FROM customer

-- view: rate_history
SELECT lpad(CAST(s.s_nationkey+1 AS STRING),2,'0')||lpad(CAST(l.l_suppkey AS STRING),5,'0') AS geoid,CASE WHEN l.l_linenumber IN (1,2,3) THEN 'sales_use' WHEN l.l_linenumber=4 THEN 'lodging_meals' WHEN l.l_linenumber IN (5,6) THEN 'property' ELSE 'other_levy' END AS category,CASE l.l_linenumber WHEN 1 THEN 'county_general_sales' WHEN 2 THEN 'use_tax' WHEN 3 THEN 'special_purpose_sales' WHEN 4 THEN 'transient_lodging' WHEN 5 THEN 'general_operating_levy' WHEN 6 THEN 'debt_service_levy' ELSE 'franchise_fee' END AS instrument_code,
CAST(row_number() OVER (PARTITION BY l.l_suppkey,l.l_linenumber ORDER BY l.l_shipdate,l.l_orderkey,l.l_partkey,l.l_quantity,l.l_extendedprice,l.l_discount,l.l_tax,l.l_returnflag,l.l_linestatus) AS BIGINT) AS seq,
CASE l.l_returnflag WHEN 'R' THEN 'repealed' WHEN 'A' THEN 'authorized_not_levied' ELSE 'levied' END AS status,
CAST(round(l.l_tax*100) AS BIGINT) AS rate_pct,CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS effective_date
FROM lineitem l JOIN supplier s ON s.s_suppkey=l.l_suppkey

-- view: ballot_measure
SELECT lpad(CAST(c.c_nationkey+1 AS STRING),2,'0')||lpad(CAST(c.c_custkey AS STRING),7,'0') AS geoid,CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS election_date,'Issue '||CAST(o.o_orderkey AS STRING) AS measure_id_local,
CASE o.o_orderpriority WHEN '1-URGENT' THEN 'levy_override' WHEN '2-HIGH' THEN 'tax_new' WHEN '3-MEDIUM' THEN 'bond_go' WHEN '4-NOT SPECIFIED' THEN 'advisory' ELSE 'tax_renewal' END AS measure_class,
CASE o.o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'passed' END AS outcome,
1000+o.o_orderkey%9000 AS votes_total,CAST(floor((1000+o.o_orderkey%9000)*(300+(o.o_orderkey*7919)%400)/1000) AS BIGINT) AS votes_yes
FROM orders o JOIN customer c ON c.c_custkey=o.o_custkey

-- view: threshold_rule
SELECT p_partkey AS id,lpad(CAST(p_partkey%25+1 AS STRING),2,'0') AS state_usps,CASE p_partkey%3 WHEN 0 THEN NULL WHEN 1 THEN 'county' ELSE 'place' END AS jurisdiction_kind,
CASE p_size%5 WHEN 0 THEN 'levy_override' WHEN 1 THEN 'tax_new' WHEN 2 THEN 'bond_go' WHEN 3 THEN 'advisory' ELSE 'tax_renewal' END AS measure_class,
CAST(CASE p_size%4 WHEN 0 THEN 50.0 WHEN 1 THEN 55.0 WHEN 2 THEN 60.0 ELSE 66.67 END AS DOUBLE) AS threshold_value,
CASE WHEN p_size%7=0 THEN NULL ELSE '199'||CAST(p_partkey%8 AS STRING)||'-'||lpad(CAST(p_size%12+1 AS STRING),2,'0')||'-01' END AS effective_from,
CASE WHEN p_size%3=0 THEN '199'||CAST(8+p_partkey%2 AS STRING)||'-06-30' ELSE NULL END AS effective_to FROM part

-- view: authority_grant
SELECT p_partkey AS id,lpad(CAST(p_partkey%25+1 AS STRING),2,'0') AS state_usps,CASE WHEN p_size%3=0 THEN NULL ELSE 'county' END AS jurisdiction_kind,CASE WHEN (p_size%7+1) IN (1,2,3) THEN 'sales_use' WHEN (p_size%7+1)=4 THEN 'lodging_meals' WHEN (p_size%7+1) IN (5,6) THEN 'property' ELSE 'other_levy' END AS category,CASE (p_size%7+1) WHEN 1 THEN 'county_general_sales' WHEN 2 THEN 'use_tax' WHEN 3 THEN 'special_purpose_sales' WHEN 4 THEN 'transient_lodging' WHEN 5 THEN 'general_operating_levy' WHEN 6 THEN 'debt_service_levy' ELSE 'franchise_fee' END AS instrument_code,
CASE WHEN p_size%11=0 THEN 'no' WHEN p_size%13=0 THEN 'conditional' ELSE 'yes' END AS permitted,CAST(p_size%10+1 AS DOUBLE) AS max_rate,
CASE WHEN p_size%7=0 THEN NULL ELSE '199'||CAST(p_partkey%8 AS STRING)||'-01-01' END AS effective_from,
CASE WHEN p_size%5=0 THEN '1999-12-31' ELSE NULL END AS effective_to FROM part

-- view: page_event
SELECT event_id,ts,lpad(CAST(user_id%25+1 AS STRING),2,'0') AS state_usps,user_id,CASE event_type WHEN 'error' THEN 403 WHEN 'click' THEN 301 ELSE 200 END AS http_status,
CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'flag' WHEN 'error' THEN 'error' ELSE NULL END AS verdict,CAST(floor(value*1000) AS BIGINT) AS input_tokens FROM events

-- view: work_item
SELECT j.geoid,k.category,CASE (length(j.name)+coalesce(j.population,0)+k.i)%7 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'complete' WHEN 4 THEN 'no_data' WHEN 5 THEN 'blocked' ELSE 'awaiting_ai' END AS status,
CAST((coalesce(j.population,0)+k.i)%6 AS BIGINT) AS attempts FROM jurisdiction j CROSS JOIN (SELECT 1 AS i,'property' AS category UNION ALL SELECT 2,'sales_use' UNION ALL SELECT 3,'lodging_meals' UNION ALL SELECT 4,'elections' UNION ALL SELECT 5,'framework') k
WHERE (k.category='framework' AND j.kind='state') OR (k.category='elections' AND j.kind='county') OR (k.category NOT IN ('framework','elections') AND j.kind IN ('county','place'))

-- view: statute_section
SELECT doc_id,lpad(CAST(doc_id%25+1 AS STRING),2,'0') AS state_usps,'v1' AS snapshot,'Sec. '||CAST(doc_id%700 AS STRING) AS citation,source AS section_title,text FROM documents

-- view: crawl_page
SELECT page_id,url,html,lpad(CAST(page_id%25+1 AS STRING),2,'0') AS state_usps,CASE WHEN page_id%5=0 THEN 403 WHEN page_id%7=0 THEN 429 ELSE 200 END AS http_status,
lower(regexp_extract(url,'://([^/?#]+)',1)) AS host FROM pages

-- view: rate_arrival
SELECT r.*,CAST(row_number() OVER (PARTITION BY geoid,instrument_code ORDER BY (seq*7919)%10007,seq) AS BIGINT) AS arrival_seq FROM rate_history r

-- view: source
SELECT s_suppkey AS id,lpad(CAST(s_nationkey+1 AS STRING),2,'0') AS scope_geoid,s_name AS name,
CASE s_suppkey%5 WHEN 0 THEN 'https://codes.st'||CAST(s_nationkey AS STRING)||'.gov/title5' WHEN 1 THEN 'https://tax.st'||CAST(s_nationkey AS STRING)||'.gov/rates.pdf' WHEN 2 THEN 'https://county'||CAST(s_suppkey AS STRING)||'.us/tax' WHEN 3 THEN 'https://league'||CAST(s_suppkey AS STRING)||'.org/x' ELSE 'http://agg'||CAST(s_suppkey AS STRING)||'.com/y' END AS url,
CASE s_suppkey%4 WHEN 0 THEN 'statute' WHEN 1 THEN 'bulk_file' WHEN 2 THEN 'portal' ELSE 'secondary' END AS source_type,CAST(s_suppkey%4+1 AS INT) AS authority_tier,
CASE s_suppkey%3 WHEN 0 THEN NULL WHEN 1 THEN 'sales_use' ELSE 'property,lodging_meals' END AS categories FROM supplier

-- view: tax_instrument
SELECT geoid,category,instrument_code,seq,status,CASE WHEN status='levied' AND seq%17=0 THEN NULL ELSE CAST(rate_pct AS DOUBLE) END AS rate_value,
CASE seq%9 WHEN 0 THEN 'mills' WHEN 1 THEN NULL ELSE 'percent' END AS rate_unit,CAST(CASE WHEN seq%4=0 THEN 5.0 ELSE NULL END AS DOUBLE) AS cap_value,CASE WHEN seq%8=0 THEN 'mills' ELSE 'percent' END AS cap_unit,
effective_date,CASE seq%6 WHEN 0 THEN '6/30/1999' WHEN 1 THEN NULL WHEN 2 THEN '1999-02-31' WHEN 3 THEN '2000-12-31' WHEN 4 THEN '1998-08-01' ELSE '2010-01-01' END AS expiration_date,
CASE seq%3 WHEN 0 THEN 'bulk_import' WHEN 1 THEN 'agent_research' ELSE 'manual' END AS extraction_method,CASE seq%5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
CASE WHEN seq%10=0 THEN '' WHEN seq%10=1 THEN NULL ELSE 'the rate is '||CAST(rate_pct AS STRING)||' percent' END AS source_quote,effective_date AS retrieved_at,
CASE WHEN rn=1 THEN NULL ELSE seq+1 END AS superseded_by_seq,CAST(substr(geoid,3) AS BIGINT) AS source_id
FROM (SELECT *,row_number() OVER (PARTITION BY geoid,category,instrument_code ORDER BY seq DESC) AS rn FROM rate_history) t

-- view: coverage_assertion
SELECT 'ballot_measure' AS domain,'state' AS scope_type,lpad(CAST(n_nationkey+1 AS STRING),2,'0') AS scope_geoid,CASE n_nationkey%5 WHEN 0 THEN 'complete' WHEN 1 THEN 'substantial' WHEN 2 THEN 'partial' WHEN 3 THEN 'spot_checked' ELSE 'none' END AS completeness,CAST(n_nationkey AS BIGINT) AS asserted_seq FROM nation
UNION ALL SELECT 'ballot_measure','county',lpad(CAST(s_nationkey+1 AS STRING),2,'0')||lpad(CAST(s_suppkey AS STRING),5,'0'),CASE s_suppkey%3 WHEN 0 THEN 'partial' WHEN 1 THEN 'none' ELSE 'complete' END,s_suppkey FROM supplier WHERE s_suppkey%2=0

-- view: check_result
SELECT event_id AS id,lpad(CAST(user_id%25+1 AS STRING),2,'0') AS geoid,CASE user_id%3 WHEN 0 THEN 'property' WHEN 1 THEN 'sales_use' ELSE 'elections' END AS category,
CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'signup' THEN 'flag' ELSE 'error' END AS verdict,ts AS created_at FROM events WHERE event_type IN ('purchase','signup','error')

-- view: search_round
SELECT event_id AS round_seq,lpad(CAST(user_id%25+1 AS STRING),2,'0') AS geoid,'property' AS category,'q'||CAST(user_id AS STRING) AS query,CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'nothing' ELSE 'found' END AS outcome,
CASE WHEN event_type IN ('error','view') THEN NULL ELSE '["u'||CAST(event_id%50 AS STRING)||'","u'||CAST(event_id%7 AS STRING)||'"]' END AS results,ts AS tried_at FROM events

-- view: model_usage
SELECT event_id,ts,CASE user_id%4 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' WHEN 2 THEN 'model-c' ELSE 'unlisted' END AS model,CAST(floor(value*1000) AS BIGINT) AS input_tokens,CAST(floor(value*100) AS BIGINT) AS output_tokens,CASE WHEN event_type='view' THEN 1 ELSE 0 END AS is_batch FROM events

-- view: archive_arrival
SELECT doc_id AS arrival_seq,source AS adapter,'https://x/'||CAST(doc_id%40 AS STRING) AS url,'2026Q'||CAST(doc_id%4+1 AS STRING) AS period_label,md5(text) AS sha FROM documents

-- view: revenue_base
SELECT lpad(CAST(c.c_nationkey+1 AS STRING),2,'0')||lpad(CAST(c.c_custkey AS STRING),7,'0') AS geoid,year(o.o_orderdate) AS fiscal_year,CASE o.o_orderkey%4 WHEN 0 THEN 'T01' WHEN 1 THEN 'T09' WHEN 2 THEN 'T19' ELSE 'T40' END AS item,o.o_orderkey AS line_no,CAST(floor(o.o_totalprice) AS BIGINT) AS amount_thousands FROM orders o JOIN customer c ON c.c_custkey=o.o_custkey

-- view: crawl_run
SELECT user_id AS run_id,min(ts) AS started_at,CASE WHEN user_id%4=0 THEN 'running' WHEN user_id%4=1 THEN 'failed' ELSE 'ok' END AS status FROM events GROUP BY user_id
