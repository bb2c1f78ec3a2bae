"""A corpus of mail derived from the ``documents`` table.

Every document becomes one message whose body is the document's text and whose headers follow
from its id: eight shapes of message in campaigns of 64 documents. The text is one SQL
expression that Spark and DuckDB both run, so checks start from the same bytes. Only the view is
shared; what is checked is computed from it separately on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = 1_788_220_800  # 2026-09-01T00:00:00Z

_DIALECT = {
    "spark": {
        "b64": "base64(CAST({x} AS BINARY))",
        "ts": "timestamp_seconds({x})",
        "sha": "sha2({x}, 256)",
        "bytes": "encode({x}, 'UTF-8')",
    },
    "duckdb": {
        "b64": "to_base64(encode({x}))",
        "ts": "make_timestamp(({x}) * 1000000)",
        "sha": "sha256({x})",
        "bytes": "encode({x})",
    },
}

_BASE = """
SELECT doc_id AS k, doc_id % 8 AS kind, CAST(floor(doc_id / 64) AS BIGINT) AS camp, text,
  'org' || CAST(doc_id % 3 AS STRING) AS org_id,
  md5(CAST(doc_id AS STRING)) AS tag,
  lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') AS dd,
  lpad(CAST(doc_id % 20 AS STRING), 2, '0') AS hh,
  lpad(CAST(doc_id % 20 + 1 AS STRING), 2, '0') AS hh1,
  CASE (1 + doc_id % 28) % 7 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu'
    WHEN 4 THEN 'Fri' WHEN 5 THEN 'Sat' ELSE 'Sun' END AS wd
FROM {documents}
"""

_NAMES = """
SELECT *,
  substr(tag, 1, 6) AS tag6,
  CAST(camp AS STRING) AS c,
  chr(CAST(97 + camp % 26 AS INT)) || chr(CAST(97 + CAST(floor(camp / 26) AS BIGINT) % 26 AS INT)) AS cc,
  substr(tag, 1, CAST(6 + camp % 9 AS INT)) AS btag,
  '45.' || CAST(camp % 200 AS STRING) || '.7.' || CAST(1 + k % 250 AS STRING) AS ip,
  CASE kind
    WHEN 0 THEN 'northbank-treasury' || CAST(camp AS STRING) || '.com'
    WHEN 1 THEN 'receivables' || CAST(camp AS STRING) || '.test'
    WHEN 2 THEN 'theweek' || CAST(camp AS STRING) || '.example'
    WHEN 3 THEN 'accountspace' || CAST(camp AS STRING) || '.com'
    WHEN 4 THEN 'n0rthbamk.test'
    WHEN 5 THEN 'vendor' || CAST(camp AS STRING) || '.co.uk'
    WHEN 6 THEN 'parts' || CAST(camp AS STRING) || '.com.au'
    ELSE 'plain' || CAST(camp AS STRING) || '.test' END AS dom
FROM b
"""

_FIELDS = """
SELECT *,
  CASE kind WHEN 0 THEN 'mara' WHEN 1 THEN 'accounts' WHEN 2 THEN 'weekly' WHEN 3 THEN 'security'
    WHEN 4 THEN 'ceo.office' WHEN 5 THEN 'desk' WHEN 6 THEN 'pay' ELSE 'user' || CAST(k % 10 AS STRING)
    END || '@' || dom AS from_addr,
  CASE kind WHEN 0 THEN 'Mara Okafor' WHEN 1 THEN 'Receivables ' || cc WHEN 2 THEN 'The Week'
    WHEN 3 THEN 'Sign-in alerts' WHEN 4 THEN 'The CFO office' WHEN 5 THEN 'Vendor Desk'
    WHEN 6 THEN 'Pay\u200broll' ELSE '' END AS display,
  CASE kind WHEN 0 THEN 'mara.okafor@mailbox' || c || '.example' WHEN 1 THEN 'statements@collect' || c || '.test'
    WHEN 2 THEN 'editor@' || dom WHEN 5 THEN 'vendor' || c || '@gmail.com' END AS reply_to,
  CASE kind WHEN 0 THEN 'rp' || CAST(k AS STRING) || '@out.' || dom
    WHEN 1 THEN 'return+' || CAST(k AS STRING) || '@out.' || dom
    WHEN 2 THEN 'w' || CAST(k AS STRING) || '@list.' || dom WHEN 3 THEN 'rp@' || dom WHEN 4 THEN 'bounce@elsewhere.example'
    WHEN 5 THEN 'bounce@bulk.co.uk' WHEN 6 THEN 'x@mail.' || dom END AS return_path,
  CASE kind
    WHEN 0 THEN 'from gate3.pphosted.com (gate3.pphosted.com [172.18.5.20]) by edge.northbank.test with ESMTPS id e' || tag6 || ' (version=TLS1_2 cipher=ECDHE); ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':52:30 +0200'
    WHEN 1 THEN 'from mx2.mimecast.com ([IPv6:2001:db8:77::9]) by edge.northbank.test with ESMTPS id e' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':20:11 +0200'
    WHEN 2 THEN 'from bulk4.google.com ([74.125.20.' || CAST(k % 250 AS STRING) || ']) by edge.northbank.test with ESMTPS id e' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':15:40 +0200'
    WHEN 3 THEN 'from se2.office365.com (52.100.7.' || CAST(k % 250 AS STRING) || ') by edge.northbank.test with ESMTPS id e' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':08:44 GMT'
    WHEN 4 THEN 'from relay.bad.test ([' || ip || ']) by mx.unknown.test with ESMTP id ' || tag6 || ' (version=TLS1_3 cipher=AES); ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':20:00 +0000'
    WHEN 5 THEN 'from o1.ptr.sendgrid.net (o1.ptr.sendgrid.net [167.89.12.' || CAST(k % 200 AS STRING) || ']) by mx1.northbank.test with ESMTP id ' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':30:05 GMT'
    WHEN 6 THEN 'from alpha.host.test (100.64.1.2) by mx.northbank.test with ESMTP id ' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':33:00 +0200'
    END AS r0,
  CASE kind
    WHEN 0 THEN 'from smtp-out.' || dom || ' (smtp-out.' || dom || ' [' || ip || ']) by gate3.pphosted.com with ESMTP id p' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':52:21 +0200'
    WHEN 1 THEN 'from out.' || dom || ' ([' || ip || ']) by mx2.mimecast.com with ESMTP id m' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':20:04 +0200'
    WHEN 2 THEN 'from composer.' || dom || ' by bulk4.google.com with HTTP id g' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':15:33 +0200'
    WHEN 3 THEN 'from portal.' || dom || ' (portal.' || dom || ' [185.33.' || CAST(camp % 200 AS STRING) || '.9]) by se2.office365.com with ESMTPSA id o' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':08:41 GMT'
    WHEN 5 THEN 'from app.' || dom || ' (app.' || dom || ' [IPv6:2001:0DB8:5::000' || substr('123456789abcdef', CAST(1 + k % 15 AS INT), 1) || ']) by o1.ptr.sendgrid.net with ESMTPSA id ' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':30:01 GMT'
    WHEN 6 THEN 'from beta.example (198.18.0.5) by gamma.example with SMTP id ' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':31:00 +0200'
    END AS r1,
  CASE kind
    WHEN 0 THEN 'from desk-' || tag6 || ' (unknown [192.168.' || CAST(camp % 200 AS STRING) || '.7]) by relay9.' || dom || ' with ESMTPA id q' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh1 || ':15:00 +0200'
    WHEN 1 THEN 'from queue.' || dom || ' (10.44.0.8) by out.' || dom || ' with LMTP id l' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':19:58 +0200'
    END AS r2,
  CASE kind WHEN 1 THEN 'from laptop (61.' || CAST(camp % 200 AS STRING) || '.12.4) by queue.' || dom || ' with ESMTPSA id s' || tag6 || '; ' || wd || ', ' || dd || ' Sep 2026 ' || hh || ':19:40 +0200' END AS r3,
  CASE WHEN kind = 9 THEN tag END AS r4,
  CASE kind
    WHEN 0 THEN 'northbank.test; dmarc=pass header.from=' || dom || '; dkim=pass header.d=' || dom || ' header.s=mk2; spf=pass smtp.mailfrom=out.' || dom
    WHEN 1 THEN 'northbank.test; spf=pass smtp.mailfrom=out.' || dom || '; dkim=fail header.d=' || dom || ' header.s=mk2; dmarc=pass header.from=' || dom
    WHEN 2 THEN 'northbank.test; dkim=pass header.d=' || dom || ' header.s=w1; dmarc=pass header.from=' || dom || '; spf=pass smtp.mailfrom=list.' || dom
    WHEN 3 THEN 'northbank.test; spf=pass smtp.mailfrom=' || dom || '; dkim=pass header.i=@' || dom || ' header.s=n7; dmarc=pass header.from=' || dom
    WHEN 4 THEN 'mx.unknown.test; spf=neutral smtp.mailfrom=x.test'
    WHEN 5 THEN 'northbank.test; spf=softfail smtp.mailfrom=bulk.co.uk; dkim=none; dmarc=fail header.from=' || dom
    WHEN 6 THEN 'outlook.com; spf=pass smtp.mailfrom=elsewhere.test; dkim=pass header.d=esp.test header.s=k9; arc=fail; dmarc=pass header.from=esp.test'
    END AS ar1,
  CASE kind WHEN 0 THEN 'northbank.test; spf=pass smtp.mailfrom=treasury@northbank.test; dmarc=pass header.from=northbank.test' END AS ar2,
  CASE kind WHEN 0 THEN 'v=1; a=ed25519-sha256; d=' || dom || '; s=mk2; h=subject:from:to; bh=' || tag6 || '=; b=Qq='
    WHEN 1 THEN 'v=1; a=rsa-sha256; d=' || dom || '; s=mk2; h=subject:from:to; bh=' || tag6 || '=; b=Qr='
    WHEN 2 THEN 'v=1; a=rsa-sha256; d=' || dom || '; s=w1; h=to:subject; l=100; bh=' || tag6 || '=; b=Yy='
    WHEN 3 THEN 'v=1; a=rsa-sha256; d=' || dom || '; s=n7; h=from:date; b=Zz=' END AS dkim,
  CASE kind WHEN 0 THEN 'Approval needed ' || c WHEN 1 THEN 'Overdue statement ' || c
    WHEN 2 THEN 'This week' WHEN 3 THEN 'New device' WHEN 4 THEN 'Quick question'
    WHEN 5 THEN 'Documents ' || c WHEN 6 THEN 'Updated report' ELSE 'Note ' || CAST(k AS STRING) END AS subject,
  wd || ', ' || dd || ' Sep 2026 ' || hh || ':05:44 ' || CASE WHEN kind = 3 THEN '-0700' ELSE '+0530' END AS date_text,
  CASE WHEN kind IN (0, 1) THEN '<' || tag6 || '.' || cc || '20260903@node.rented.test>'
    WHEN kind IN (2, 3) THEN '<' || cc || '/' || tag6 || '@' || dom || '>'
    ELSE '<' || cc || '-' || tag6 || '@' || dom || '>' END AS msgid,
  CASE WHEN kind IN (0, 1) THEN 'PostKit/' || CAST(camp % 40 AS STRING) || '.2' END AS mailer,
  CASE kind WHEN 5 THEN 'AgentMail 1.' || c END AS agent,
  CASE kind WHEN 2 THEN '<weekly.' || dom || '>' END AS list_id,
  CASE kind WHEN 6 THEN 'Second <second@parts.test>' END AS from2,
  CASE kind WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf' WHEN 5 THEN 'application/zip'
    WHEN 6 THEN 'application/octet-stream' END AS att_type,
  CASE kind WHEN 0 THEN 'approval.pdf' WHEN 1 THEN 'statement-' || c || '.pdf' WHEN 5 THEN 'papers.zip'
    WHEN 6 THEN 'report.pdf' END AS att_name,
  CASE WHEN kind IN (0, 1) THEN 'payload of campaign ' || c WHEN kind IN (5, 6) THEN 'payload ' || CAST(k AS STRING) END AS att_payload,
  CASE kind
    WHEN 0 THEN text || chr(10) || 'Kindly wire the balance right away. This stays confidential. As CEO I approve it in writing, here:' || chr(10) || 'https://' || dom || '/approvals/login?item=' || tag6 || chr(10) || 'Total EUR 91,400.'
    WHEN 1 THEN text || chr(10) || 'Statement ' || c || ' is past its deadline. Our new account number is enclosed.' || chr(10) || 'hxxps://' || dom || '/statement/auth?doc=' || c || ', or answer ap@northbank.test'
    WHEN 2 THEN text || chr(10) || 'All stories: https://' || dom || '/weekly/36. Preferences: https://' || dom || '/prefs?id=' || CAST(k % 50 AS STRING)
    WHEN 3 THEN '<html><body><div>' || text || '</div>' || chr(10) || '<div>Somebody used a new device to sign in.</div><div><a href="https://' || dom || '/account/session?id=' || tag6 || '">Review the session</a></div></body></html>'
    WHEN 4 THEN text || chr(10) || 'See http://northbank-login.example:8080/sso and http://bit[.]ly/' || tag6
    WHEN 6 THEN text || chr(10) || 'Please verify your account.'
    ELSE text END AS body
FROM n
"""

#: header name, value expression (NULL: absent), in emission order
HEADERS = (
    ("Received", "r0"), ("Received", "r1"), ("Received", "r2"), ("Received", "r3"),
    ("Received", "r4"),
    ("Authentication-Results", "ar1"), ("Authentication-Results", "ar2"),
    ("DKIM-Signature", "dkim"),
    ("Return-Path", "'<' || return_path || '>'"),
    ("From", "CASE WHEN kind = 7 THEN from_addr ELSE display || ' <' || from_addr || '>' END"),
    ("From", "from2"),
    ("Reply-To", "reply_to"),
    ("To", "'Treasury Desk <treasury@northbank.test>'"),
    ("Subject", "subject"),
    ("X-Mailer", "CASE WHEN camp % 2 = 0 THEN mailer END"),
    ("Date", "date_text"),
    ("Message-ID", "msgid"),
    ("X-Mailer", "CASE WHEN camp % 2 = 1 THEN mailer END"),
    ("User-Agent", "agent"),
    ("List-Id", "list_id"),
    ("MIME-Version", "'1.0'"),
    ("Content-Type", "content_type"),
)

_CONTENT_TYPE = """
SELECT *, CASE WHEN att_type IS NOT NULL THEN 'multipart/mixed; boundary="b1_' || btag || '"'
  WHEN kind = 3 THEN 'text/html; charset="utf-8"' ELSE 'text/plain; charset="utf-8"' END AS content_type
FROM f
"""


def _wire(name: str, value: str) -> str:
    """How a header is written: Received folded, the hidden character as an encoded word."""
    if name == "Received":
        value = f"replace({value}, '; ', ';' || chr(10) || ' ')"
    if name == "From" and "display" in value:
        value = (
            "CASE WHEN kind = 7 THEN from_addr WHEN kind = 6 THEN '=?utf-8?B?' || "
            "{b64(display)} || '?= <' || from_addr || '>' ELSE '\"' || display || '\" <' || "
            "from_addr || '>' END"
        )
    return f"coalesce('{name}: ' || {value} || chr(10), '')"


def _raw() -> str:
    head = " || ".join(_wire(n, v) for n, v in HEADERS)
    text_part = (
        "'--b1_' || btag || chr(10) || 'Content-Type: text/plain; charset=\"utf-8\"' || chr(10) || "
        "'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || body || chr(10)"
    )
    file_part = (
        "'--b1_' || btag || chr(10) || 'Content-Type: ' || att_type || chr(10) || "
        "'Content-Transfer-Encoding: base64' || chr(10) || "
        "'Content-Disposition: attachment; filename=\"' || att_name || '\"' || chr(10) || chr(10) || "
        "{b64(att_payload)} || chr(10) || '--b1_' || btag || '--' || chr(10)"
    )
    return (
        f"{head} || CASE WHEN att_type IS NOT NULL THEN chr(10) || {text_part} || {file_part} "
        "ELSE chr(10) || body END"
    )


def _apply(sql: str, dialect: str) -> str:
    """Fill the few functions whose names differ."""
    for name, form in _DIALECT[dialect].items():
        mark = "{" + name + "("
        while mark in sql:
            start = sql.index(mark)
            end = sql.index(")}", start)
            inner = sql[start + len(mark) : end]
            sql = sql[:start] + form.replace("{x}", inner) + sql[end + 2 :]
    return sql


def mail_ctes(dialect: str, documents: str = "documents") -> str:
    """``b, n, f, t, mail`` common table expressions; ``mail`` has one row per message."""
    final = (
        "SELECT *, {ts(" + str(EPOCH) + " + k * 60)} AS acquired_at, " + _raw() + " AS raw FROM t"
    )
    return _apply(
        f"b AS ({_BASE.replace('{documents}', documents)}), n AS ({_NAMES}), f AS ({_FIELDS}), "
        f"t AS ({_CONTENT_TYPE}), mail AS ({final})",
        dialect,
    )


def mail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in Spark, with its building blocks."""
    name = "workload_documents"
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").createOrReplaceTempView(name)
    return spark.sql(f"WITH {mail_ctes('spark', name)} SELECT * FROM mail")


#: Messages of one task that analyses them.
MESSAGES_A_TASK = 2000


def spread(rows: DataFrame, count: int = 0) -> DataFrame:
    """Deal rows out by their first column: the tables come as one file each.

    The number is given, as small partitions would be merged again and the work on a row is large; it
    grows with the ``count`` of the rows.
    """
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, count // MESSAGES_A_TASK)
    return rows.repartition(tasks, rows[rows.columns[0]])


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as raw messages: what the operators are given."""
    count = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return spread(mail_rows(spark, sf_dir), count).select(
        "k",
        "org_id",
        F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".eml")).alias("filename"),
        F.lit("upload").alias("source"),
        "acquired_at",
        F.encode("raw", "UTF-8").alias("content"),
    )
