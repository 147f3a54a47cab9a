"""Rate-limit replay."""

from __future__ import annotations

from docpipe.operators import credentials, ratelimit
from docpipe.registry import query
from docpipe.registry.credentials import LIMIT

# At 60 s a token of the test data hardly repeats: a day and a limit of two
# make both policies reject.
WINDOW = 86_400
MAX = 2


def requests(x):
    """The columns a limiter needs; replayed rows carry no others to Python."""
    return x("fx_usage").select("id", "token_id", "timestamp")


FIXED = f"""
SELECT u.*, epoch_us(timestamp) // {WINDOW * 1_000_000} AS window_id,
  row_number() OVER (PARTITION BY token_id, epoch_us(timestamp) // {WINDOW * 1_000_000} ORDER BY timestamp, id) AS request_rank
FROM fx_usage u"""


@query("rate_limit_fixed", f"SELECT id, token_id, window_id, request_rank <= {MAX} AS allowed FROM ({FIXED})")
def rate_limit_fixed(x):
    decided = ratelimit.rate_limit_fixed(x("fx_usage"), MAX, WINDOW)
    return decided.select("id", "token_id", "window_id", "allowed")


SLIDING = f"""
WITH RECURSIVE r AS (
  SELECT token_id, id, epoch_us(timestamp) AS us,
         row_number() OVER (PARTITION BY token_id ORDER BY timestamp, id) AS rn FROM fx_usage),
f(token_id, id, rn, allowed, hist) AS (
  SELECT token_id, id, rn, TRUE, [us] FROM r WHERE rn = 1
  UNION ALL
  SELECT r.token_id, r.id, r.rn,
    len(list_filter(f.hist, lambda h: h > r.us - {WINDOW * 1_000_000})) < {MAX},
    CASE WHEN len(list_filter(f.hist, lambda h: h > r.us - {WINDOW * 1_000_000})) < {MAX}
         THEN list_append(list_filter(f.hist, lambda h: h > r.us - {WINDOW * 1_000_000}), r.us)
         ELSE list_filter(f.hist, lambda h: h > r.us - {WINDOW * 1_000_000}) END
  FROM f JOIN r ON r.token_id = f.token_id AND r.rn = f.rn + 1)
SELECT token_id, id, allowed FROM f"""


@query("rate_limit_sliding", SLIDING)
def rate_limit_sliding(x):
    decided = ratelimit.rate_limit_sliding(requests(x), MAX, WINDOW)
    return decided.select("token_id", "id", "allowed")


HEADROOM = f"""
SELECT id, token_id, l AS rate_limit, greatest(l - request_rank, 0) AS remaining,
  (window_id + 1) * {WINDOW} AS reset_epoch
FROM (SELECT f.*, CAST(coalesce(t.lim, 60) AS INT) AS l FROM ({FIXED}) f
      LEFT JOIN (SELECT token_id, {LIMIT} AS lim FROM fx_tokens) t ON t.token_id = f.token_id)"""


@query("rate_limit_headroom", HEADROOM)
def rate_limit_headroom(x):
    limits = credentials.default_rate_limit(x("fx_tokens"))
    decided = ratelimit.rate_limit_headroom(x("fx_usage"), limits, WINDOW)
    return decided.select("id", "token_id", "rate_limit", "remaining", "reset_epoch")


@query("rejections", f"""
SELECT token_id, count(*) AS requests, count(*) FILTER (WHERE request_rank > {MAX}) AS rejected
FROM ({FIXED}) GROUP BY token_id""")
def rejections(x):
    return ratelimit.rejections(ratelimit.rate_limit_fixed(x("fx_usage"), MAX, WINDOW))


@query("rejections_sliding", SLIDING.replace("SELECT token_id, id, allowed FROM f", """
SELECT token_id, count(*) AS requests, count(*) FILTER (WHERE NOT allowed) AS rejected FROM f GROUP BY token_id"""))
def rejections_sliding(x):
    return ratelimit.rejections(ratelimit.rate_limit_sliding(requests(x), MAX, WINDOW))
