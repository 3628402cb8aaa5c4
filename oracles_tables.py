"""DuckDB twins for the site, preference, billing and usage tables (page-derived)."""

from __future__ import annotations

from tidemark.sources.fixtures import N_OWNERS

HOST = (r"lower(regexp_extract(CASE WHEN contains(trim(d), '://') THEN trim(d) ELSE 'http://' || trim(d) END, "
        r"'^[A-Za-z][A-Za-z0-9+.\-]*://([^@/?#]*@)?([^:/?#]*)', 2))")
HOST_OK = f"CASE WHEN {HOST} <> '' AND NOT regexp_matches({HOST}, '[\\s<>^|%\\[\\]\\\\]') THEN {HOST} END"

PAGE_CTES = f"""ps_raw AS (SELECT page_id, 'ps-' || CAST(page_id AS VARCHAR) AS site_id,
    'owner-' || CAST(page_id % {N_OWNERS} AS VARCHAR) AS owner_sub,
    CASE WHEN page_id % 19 = 0 THEN '   ' ELSE '  Site ' || CAST(page_id AS VARCHAR) || ' ' END AS name,
    CASE WHEN page_id % 11 = 0 THEN [url, ' ']
         WHEN page_id % 13 = 0 THEN ['bad host.example']
         WHEN page_id % 17 = 0 THEN []::VARCHAR[]
         ELSE [url, regexp_replace(url, '^[a-z]+://', ''), upper(regexp_replace(url, '^[a-z]+://', ''))] END AS domains,
    CASE page_id % 3 WHEN 0 THEN 'needs_payment' WHEN 1 THEN 'free_tier' ELSE 'active_paid' END AS plan,
    CAST((page_id * 37) % 20000 - 5000 AS BIGINT) AS request_allowance,
    CASE page_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' WHEN 2 THEN 'no' WHEN 3 THEN NULL ELSE 'bogus' END
      AS compliance_level
  FROM pages),
pp_owner AS (SELECT DISTINCT owner_sub AS cognito_sub, CAST(regexp_extract(owner_sub, '(\\d+)$', 1) AS INT) AS n FROM ps_raw),
pp AS (SELECT cognito_sub,
    CASE WHEN n % 4 = 1 THEN NULL ELSE 'cus_' || CAST(n AS VARCHAR) END AS stripe_customer_id,
    CASE WHEN n % 5 = 2 THEN '' ELSE 'pm_' || CAST(n AS VARCHAR) END AS stripe_payment_method_id,
    '4242' AS stripe_last4,
    CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS is_payment_active
  FROM pp_owner),
po AS (SELECT 'ps-' || CAST(page_id AS VARCHAR) AS site_id,
    CASE page_id % 6 WHEN 0 THEN 'succeeded' WHEN 5 THEN 'requires_action' ELSE 'failed' END AS status,
    CASE page_id % 6 WHEN 1 THEN 'card' WHEN 2 THEN 'invalid_request' WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'api' END
      AS error_kind,
    CASE page_id % 6 WHEN 1 THEN 'Your card was declined.' WHEN 2 THEN 'No such PaymentMethod: ''pm_x'''
         WHEN 3 THEN 'Amount must be at least 50 cents' WHEN 4 THEN 'Rate limit' END AS message
  FROM pages),
bil_cand AS (SELECT s.site_id, s.owner_sub,
    COALESCE(p.is_payment_active = 1 AND p.stripe_customer_id IS NOT NULL AND p.stripe_customer_id <> ''
             AND p.stripe_payment_method_id IS NOT NULL AND p.stripe_payment_method_id <> '', FALSE) AS ready
  FROM ps_raw s LEFT JOIN pp p ON p.cognito_sub = s.owner_sub WHERE s.plan = 'needs_payment'),
bil_res AS (SELECT c.site_id, c.owner_sub, o.status = 'succeeded' AS succeeded,
    (o.status <> 'succeeded') AND CASE COALESCE(o.error_kind, CASE WHEN o.status <> 'succeeded' THEN 'text' END)
        WHEN 'card' THEN TRUE
        WHEN 'invalid_request' THEN contains(lower(COALESCE(o.message, '')), 'paymentmethod')
                                    OR contains(lower(COALESCE(o.message, '')), 'customer')
        WHEN 'text' THEN TRUE ELSE FALSE END AS method_problem
  FROM bil_cand c JOIN po o ON o.site_id = c.site_id WHERE c.ready),
bil_sites AS (SELECT s.site_id,
    CASE WHEN r.succeeded THEN 'active_paid' WHEN NOT r.succeeded THEN 'payment_failed' ELSE s.plan END AS plan,
    CAST(CASE WHEN r.succeeded THEN s.request_allowance + 500000 ELSE s.request_allowance END AS BIGINT) AS request_allowance
  FROM ps_raw s LEFT JOIN bil_res r ON r.site_id = s.site_id),
bil_prefs AS (SELECT p.cognito_sub,
    CAST(CASE WHEN p.cognito_sub IN (SELECT owner_sub FROM bil_res WHERE method_problem) THEN 0 ELSE p.is_payment_active END
         AS INT) AS is_payment_active
  FROM pp p),
pe AS (
  SELECT TIMESTAMP '2024-02-01 00:00:00' + to_hours(n) AS event_time, 'setup_intent.succeeded' AS type,
         cognito_sub AS user_sub, 'cus_' || CAST(n AS VARCHAR) AS customer_id,
         'pm_new_' || CAST(n AS VARCHAR) AS payment_method_id, '1881' AS last4
  FROM pp_owner WHERE n % 2 = 0
  UNION ALL
  SELECT TIMESTAMP '2024-02-01 00:00:00' + to_hours(3 * n + 1), 'payment_method.detached', NULL,
         'cus_' || CAST(n AS VARCHAR), NULL, NULL
  FROM pp_owner WHERE n % 3 <> 2),
pe_user AS (
  SELECT user_sub AS cognito_sub, event_time, type, payment_method_id, last4 FROM pe
  WHERE type = 'setup_intent.succeeded' AND COALESCE(user_sub, '') <> '' AND COALESCE(customer_id, '') <> ''
        AND COALESCE(payment_method_id, '') <> ''
  UNION ALL
  SELECT p.cognito_sub, e.event_time, e.type, NULL, NULL FROM pe e JOIN pp p ON p.stripe_customer_id = e.customer_id
  WHERE e.type = 'payment_method.detached' AND COALESCE(e.customer_id, '') <> ''),
pe_last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cognito_sub ORDER BY event_time DESC, type DESC) AS rn
                           FROM pe_user) x WHERE rn = 1),
pe_prefs AS (SELECT p.cognito_sub, p.stripe_customer_id,
    CASE WHEN l.type = 'setup_intent.succeeded' THEN l.payment_method_id
         WHEN l.type = 'payment_method.detached' THEN NULL ELSE p.stripe_payment_method_id END AS stripe_payment_method_id,
    CASE WHEN l.type = 'setup_intent.succeeded' THEN l.last4
         WHEN l.type = 'payment_method.detached' THEN NULL ELSE p.stripe_last4 END AS stripe_last4,
    CAST(CASE WHEN l.type = 'setup_intent.succeeded' THEN 1 WHEN l.type = 'payment_method.detached' THEN 0
              ELSE p.is_payment_active END AS INT) AS is_payment_active
  FROM pp p LEFT JOIN pe_last l ON l.cognito_sub = p.cognito_sub),
ps_clean AS (SELECT site_id, owner_sub, trim(name) AS name,
    list_transform(domains, lambda d: {HOST_OK}) AS hosts, domains, plan, request_allowance,
    COALESCE(compliance_level, 'maybe') AS compliance_level,
    CASE WHEN name IS NULL OR trim(name) = '' THEN 'name must be a non-empty string'
         WHEN domains IS NULL OR len(domains) = 0 THEN 'domains must be a non-empty array'
         WHEN list_bool_or(list_transform(domains, lambda d: d IS NULL OR trim(d) = '')) THEN
              'domains must contain only non-empty strings'
         WHEN list_bool_or(list_transform(domains, lambda d: ({HOST_OK}) IS NULL)) THEN 'invalid domain format'
         WHEN compliance_level IS NOT NULL AND compliance_level NOT IN ('yes', 'maybe', 'no') THEN
              'compliance_level must be yes, maybe or no'
    END AS error
  FROM ps_raw),
use_sum AS (SELECT s.site_id, s.owner_sub, s.plan,
    CAST(CASE WHEN s.plan = 'free_tier' THEN 10000 ELSE 0 END AS BIGINT) AS initial_allowance,
    CAST(COALESCE(s.request_allowance, 0) AS BIGINT) AS request_allowance,
    CAST(greatest(0, CASE WHEN s.plan = 'free_tier' THEN 10000 ELSE 0 END - COALESCE(s.request_allowance, 0)) AS BIGINT)
      AS requests_used,
    (COALESCE(s.request_allowance, 0) <= 0 AND NOT COALESCE(p.is_payment_active = 1, FALSE)) AS locked
  FROM ps_raw s LEFT JOIN pp p ON p.cognito_sub = s.owner_sub),
up_raw AS (SELECT page_id, k, site_id, CASE WHEN page_id % 6 = 5 THEN 'owner-none' ELSE owner_sub END AS asked_by,
    TIMESTAMP '2024-03-01 00:00:00' + to_hours((page_id * 7 + k * 5) % 11) AS updated_at,
    CASE WHEN page_id % 4 = k THEN NULL WHEN page_id % 13 = 0 THEN '' ELSE 'Name ' || k END AS name,
    CASE WHEN k = 2 THEN ['new.example'] END AS domains, CASE WHEN k = 1 AND page_id % 3 = 0 THEN 'free_tier' END AS plan,
    CASE WHEN k = 0 THEN ['event'] END AS allowed_fields,
    CASE WHEN k = 1 AND page_id % 2 = 0 THEN 'no' WHEN k = 2 AND page_id % 9 = 0 THEN 'bogus' END AS compliance_level
  FROM ps_raw, (SELECT unnest([0, 1, 2])::BIGINT AS k) ks),
up_ok AS (SELECT u.* FROM up_raw u JOIN ps_raw s ON s.site_id = u.site_id AND s.owner_sub = u.asked_by
  WHERE COALESCE(u.name, 'x') <> '' AND COALESCE(u.compliance_level, 'no') <> 'bogus'
    AND NOT (u.name IS NULL AND u.domains IS NULL AND u.plan IS NULL AND u.allowed_fields IS NULL AND u.compliance_level IS NULL)),
up_cells AS (UNPIVOT (SELECT site_id, updated_at, name, domains[1] AS domains, plan, allowed_fields[1] AS allowed_fields, compliance_level FROM up_ok)
  ON name, domains, plan, allowed_fields, compliance_level INTO NAME field VALUE v),
up_last AS (SELECT site_id, field, v, updated_at FROM up_cells
  QUALIFY row_number() OVER (PARTITION BY site_id, field ORDER BY updated_at DESC, v DESC) = 1),
up_sites AS (SELECT s.site_id, COALESCE(n.v, s.name) AS name, COALESCE(d.v, array_to_string(s.domains, ',')) AS domains, COALESCE(p.v, s.plan) AS plan,
    COALESCE(a.v, '') AS allowed_fields, COALESCE(c.v, s.compliance_level) AS compliance_level,
    strftime(t.at, '%Y-%m-%d %H:%M:%S') AS updated_at
  FROM ps_raw s LEFT JOIN up_last n ON n.site_id = s.site_id AND n.field = 'name'
  LEFT JOIN up_last d ON d.site_id = s.site_id AND d.field = 'domains' LEFT JOIN up_last p ON p.site_id = s.site_id AND p.field = 'plan'
  LEFT JOIN up_last a ON a.site_id = s.site_id AND a.field = 'allowed_fields'
  LEFT JOIN up_last c ON c.site_id = s.site_id AND c.field = 'compliance_level'
  LEFT JOIN (SELECT site_id, MAX(updated_at) AS at FROM up_last GROUP BY 1) t ON t.site_id = s.site_id),
new_req AS (SELECT c.*, k, c.error IS NOT NULL AS bad FROM ps_clean c JOIN ps_raw USING (site_id), (SELECT unnest([0, 1]) AS k) ks WHERE k = 0 OR page_id % 10 = 0),
new_sites AS (SELECT site_id, CASE WHEN name = '' THEN '' ELSE name || ' ' || k END AS name, CASE WHEN bad THEN 400
    WHEN site_id IN (SELECT site_id FROM ps_raw WHERE page_id % 7 = 0) OR k < (SELECT MAX(k) FROM new_req o WHERE o.site_id = new_req.site_id) THEN 409
    ELSE 201 END AS status, error, strftime(TIMESTAMP '2024-03-01 00:00:00' + to_hours(5 - k), '%Y-%m-%d %H:%M:%S') AS created_at FROM new_req)"""


def pages_sql(body: str) -> str:
    return f"WITH {PAGE_CTES}\n{body}"
