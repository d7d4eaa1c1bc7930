"""Account numbers before further words."""

import pytest

from tallywing.llm import pii


@pytest.mark.parametrize(
    "text, spans",
    [
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "iban:5:27"),
        ("account DE89 3704 0044 0532 0130 00 Please pay", "iban:8:35"),
        ("DE89 3704 0044 0532 0130 00 5 EUR", "iban:0:27"),
        ("DE89370400440532013000 GB29 NWBK 6016 1331 9268 19 NL91ABNA0417164300 A", "iban:0:22,iban:23:50,iban:51:69"),
        ("AB12 DE89 3704 0044 0532 0130 00", "iban:5:32"),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S EUR", "iban:0:38"),
        ("DE89370400440532013001 BIC COBADEFFXXX", ""),
    ],
)
def test_account_numbers_end_at_their_length(spark, text, spans):
    assert pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans == spans
