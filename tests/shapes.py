"""Messages of the shapes the analysis has to tell apart, written for these tests."""

from __future__ import annotations

import datetime

SHEET = (
    "Content-Type: application/pdf; name=\"overview.pdf\"\nContent-Transfer-Encoding: base64\n"
    "Content-Disposition: attachment; filename=\"overview.pdf\"\n\nJVBERi0xLjcK\n"
)


def _kit(domain, ip, tag, display, local, subject, body, backdated=False, injected=False) -> bytes:
    """Mail of one rented sending kit: three hops, the lower two its own."""
    oldest = "14:31:00" if backdated else "14:01:58"
    head = [
        f"Received: from gate.mimecast.com (gate.mimecast.com [10.61.0.3]) by\n\tedge.northbank.test with ESMTPS id E{tag};\n\tFri, 11 Sep 2026 14:02:09 +0200",
        f"Received: from {domain} ({domain} [{ip}]) by gate.mimecast.com\n\twith ESMTP id M{tag}; Fri, 11 Sep 2026 14:02:03 +0200",
        f"Received: from worker{tag} (198.51.100.77) by {domain}\n\twith LMTP id W{tag}; Fri, 11 Sep 2026 {oldest} +0200",
        f"Authentication-Results: northbank.test; dmarc=pass header.from={domain};\n\tdkim=pass header.d={domain} header.s=a1; spf=pass smtp.mailfrom=rp.{domain}",
    ]
    if injected:
        head.append("Authentication-Results: northbank.test; dmarc=pass header.from=northbank.test")
    head += [
        f"From: {display} <{local}@{domain}>",
        f"Reply-To: <{local}@answers.example>",
        "To: treasury@northbank.test",
        f"Subject: {subject}",
        f"Message-ID: <{tag}.20260911@{local}.node.test>",
        "X-Mailer: PostKit/3.2",
        "Date: Fri, 11 Sep 2026 14:01:50 +0200",
        f"Return-Path: <{tag}@rp.{domain}>",
        "MIME-Version: 1.0",
        f'Content-Type: multipart/mixed; boundary="=-{tag}-kit"',
    ]
    parts = f"--=-{tag}-kit\nContent-Type: text/plain; charset=\"utf-8\"\n\n{body}\n\n--=-{tag}-kit\n{SHEET}\n--=-{tag}-kit--\n"
    return ("\n".join(head) + "\n\n" + parts).encode()


FRAUD = _kit(
    "northbank-treasury.com", "192.0.2.61", "a7c90e", "Mara Okafor", "mara", "Approval",
    "As CEO I approve the transfer to our new beneficiary, right away.\nKeep it confidential. The form:\nhttps://northbank-treasury.com/approvals/login?item=61",
    backdated=True, injected=True,
)
WAVE_A = _kit(
    "harbour-dues.test", "192.0.2.75", "b8d01f", "Harbour Dues", "dues", "Dues notice",
    "Your harbour dues are past their deadline; the wire must arrive this week.\nDetails:\nhttps://harbour-dues.test/notice/auth?ref=75",
)
WAVE_B = _kit(
    "quay-levies.test", "192.0.2.98", "c9e120", "Quay Levies", "levies", "Levy notice",
    "The levy for your berth expires on Monday. Send the remittance by Sunday.\nDetails:\nhttps://quay-levies.test/notice/auth?ref=98",
)
NEWSLETTER = b"""Received: from list7.google.com ([74.125.9.30]) by edge.northbank.test with ESMTPS id E1;
\tThu, 10 Sep 2026 06:30:20 +0000
Received: from composer.gardeners.example by list7.google.com with HTTP id G1;
\tThu, 10 Sep 2026 06:30:12 +0000
Authentication-Results: northbank.test; dkim=pass header.d=gardeners.example header.s=g4;
\tdmarc=pass header.from=gardeners.example; spf=pass smtp.mailfrom=list.gardeners.example
Return-Path: <x7@list.gardeners.example>
From: Allotment Post <post@gardeners.example>
To: treasury@northbank.test
List-Id: <post.gardeners.example>
Subject: Pruning in autumn
Date: Thu, 10 Sep 2026 06:30:00 +0000
Message-ID: <issue-37@gardeners.example>
MIME-Version: 1.0
Content-Type: text/plain; charset="utf-8"

Pears first, then plums. Pictures: https://gardeners.example/issue/37
"""
RESET = b"""Received: from se2.office365.com (52.100.7.8) by edge.northbank.test with ESMTPS id E2;
\tSat, 12 Sep 2026 19:20:40 +0000
Received: from portal.bikeclub.test (portal.bikeclub.test [185.33.4.9]) by se2.office365.com with ESMTPSA id O2;
\tSat, 12 Sep 2026 19:20:36 +0000
Authentication-Results: northbank.test; spf=pass smtp.mailfrom=bikeclub.test;
\tdkim=pass header.i=@bikeclub.test header.s=b9; dmarc=pass header.from=bikeclub.test
Return-Path: <rp@bikeclub.test>
From: Bike club <desk@bikeclub.test>
To: <treasury@northbank.test>
Subject: Key for your locker
Date: Sat, 12 Sep 2026 19:20:30 +0000
Message-ID: <locker-4711@bikeclub.test>
MIME-Version: 1.0
Content-Type: text/html; charset="utf-8"

<html><body><div>A new key was made for locker 12.</div>
<div><a href="https://bikeclub.test/account/locker?key=4711">Choose a new password</a></div></body></html>
"""
BROKEN = b"""Received: junk without any clause; someday
From: <@nobody@@x.invalid
From: Again <again@x.invalid>
From: Third <third@x.invalid>
Subject: =?no-charset?Q?=ZZ?=
Date: Blursday, 45 Smarch 2026
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary="lost"

--lost
Content-Type: text/plain; charset="x-unheard-of"
Content-Transfer-Encoding: base64

*** neither base64 nor ended ***
"""
HEADLESS = b"From: a@plain.test\nSubject: hi\n\nhello\n"
SHAPES = {
    "fraud": FRAUD, "wave_a": WAVE_A, "wave_b": WAVE_B, "newsletter": NEWSLETTER, "reset": RESET,
    "broken": BROKEN, "headless": HEADLESS,
}


def raw_frame(spark, shapes=None, org="o"):
    start = datetime.datetime(2026, 9, 10)
    rows = [
        (org, name, "upload", start + datetime.timedelta(minutes=i), bytearray(content))
        for i, (name, content) in enumerate((shapes or SHAPES).items())
    ]
    from relaytrail.sources.messages import RAW_SCHEMA

    return spark.createDataFrame(rows, RAW_SCHEMA)
