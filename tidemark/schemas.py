"""Explicit schemas of the stored tables and of the landed files."""

STOCK_DAILY = "code string, d date, o double, h double, l double, c double, v bigint"
INVESTOR_FLOW = "code string, d date, individual_net bigint, foreign_net bigint, institution_net bigint"
CREDIT_BALANCE = "code string, d date, credit_amt bigint, credit_ratio double"
INSTRUMENTS = "code string, name string, corp_code string"
SIGNALS = ("code string, d date, individual_flow_ratio double, credit_surge_ratio double, volume_ratio double, "
           "foreign_flow_ratio double, institution_flow_ratio double, credit_ratio_level double, heat_score double, signal string")
DISCLOSURES = "rcept_no string, code string, d date, report_nm string, url string"
FINANCIALS = ("code string, period string, fs_div string, revenue double, op_income double, net_income double, "
              "assets double, liabilities double, equity double")
SHARES = "code string, period string, issued bigint, treasury bigint, floating bigint"
POSITIONS = ("code string, strategy string, name string, entry_date date, entry_px double, qty double, stop_px double, "
             "max_hold_days int, mode string")
TRADES = ("id bigint, ts timestamp, mode string, side string, code string, name string, qty double, price double, amount double, "
          "strategy string, agents string, exit_reason string, realized_pct double")
DECISIONS = ("id bigint, ts timestamp, code string, agent string, score double, decision string, rationale string, "
             "model string, input_hash string")
EQUITY_DAILY = "d date, mode string, strategy string, cash double, positions_value double, total_equity double"
RUNS = "id bigint, ts timestamp, strategy string, start_d date, end_d date, params map<string,string>, summary string"
RUN_TRADES = ("run_id bigint, code string, entry_d date, exit_d date, entry_px double, exit_px double, ret_pct double, "
              "exit_reason string")
CURSORS = "source string, code string, last_seen timestamp"
SETTINGS = "key string, value string"

LANDED_FLOW = ("code string, page int, rows array<struct<stck_bsop_date:string,prsn_ntby_tr_pbmn:string,"
               "frgn_ntby_tr_pbmn:string,orgn_ntby_tr_pbmn:string>>")
LANDED_CREDIT = ("code string, page int, rows array<struct<stlm_date:string,whol_loan_rmnd_amt:string,whol_loan_rmnd_rate:string>>")
LANDED_FILING = "page int, list array<struct<stock_code:string,rcept_no:string,rcept_dt:string,report_nm:string>>"
LANDED_ACCOUNT = "list array<struct<corp_code:string,fs_div:string,account_nm:string,thstrm_amount:string>>"
LANDED_SHARES = "code string, period string, list array<struct<se:string,istc_totqy:string,tesstk_co:string,distb_stock_co:string>>"
CORP_CODE_XML = "corp_code string, corp_name string, stock_code string, modify_date string"
