"""Types of the domain tables, as DDL."""

COMPANIES = ("id int, ticker string, name string, cik string, sector string, sic_code string, created_at timestamp")
FILINGS = (
    "id int, company_id int, accession_number string, form_type string, filed_date date, fiscal_year_end date, raw_text string, processed boolean, created_at timestamp"
)
NEWS = (
    "id int, url string, headline string, body string, source string, published_at timestamp, sentiment_label string, sentiment_score double, processed boolean, created_at timestamp"
)
ARTICLE_COMPANIES = ("id int, article_id int, company_id int, created_at timestamp")
SIGNALS = "struct<n_sentences:int,mean_negative:double,max_negative:double,risk_density:double,mean_neutral:double,mean_positive:double,capped:boolean>"
RISK_SCORES = (
    f"id int, company_id int, filing_id int, scored_at timestamp, risk_score double, confidence double, signal_breakdown {SIGNALS}, model_version string"
)
FILING_LABELS = (
    "id int, filing_id int, realized_vol double, vol_label string, window_start date, window_end date, n_returns int, price_source string, tercile_low double, tercile_high double, created_at timestamp"
)
ALERTS = ("id int, company_id int, triggered_at timestamp, alert_type string, severity string, explanation string, resolved boolean")
ALERT_EXPLANATIONS = (
    "id int, alert_id int, status string, narrative string, cited_ids array<int>, model string, abstain_reason string, created_at timestamp"
)
PRICE_HISTORY = ("id int, company_id int, date date, open double, high double, low double, close double, adj_close double, volume long")
API_KEYS = (
    "id int, key_hash string, owner string, requests_per_hour int, created_at timestamp, last_used_at timestamp, active boolean, expires_at timestamp"
)
PREDICTION_LOGS = (
    "id int, company_id int, predicted_at timestamp, model_version string, input_features string, output_score double, confidence double, feature_contributions string, runtime_ms double, inference_backend string"
)
PRICE_CSV = ("ticker string, date date, open double, high double, low double, close double, adj_close double, volume long")
NEWS_CSV = ("ticker string, date date, news_n int, news_neg double, neg_ratio double")
CONSTITUENTS_CSV = ("Symbol string, Security string, Sector string, CIK string")
PARITY = (
    "samples array<struct<text:string,input_ids:array<long>,attention_mask:array<long>,token_type_ids:array<long>,logits:array<float>,probs:map<string,double>>>"
)
