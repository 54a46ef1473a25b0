"""Tables that a query reads several times are made once."""

from postledger.plans import catalog


def test_job_reports_reads_lines_for_records_and_pay_alone(spark):
    out = catalog.QUERIES["job_reports"](spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in out._jdf.queryExecution().toString()
