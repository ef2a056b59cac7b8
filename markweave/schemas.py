"""Schemas of the registry tables."""

from __future__ import annotations

EVENT = "struct<type:string,date:string,gazette:string,parties:array<string>,designations:array<string>>"
SCHEMAS = {
    "gazettes": "id string, filename string, sha256 string, gazette_type string, issue_year int, issue_number int, status string, row_count int, uploaded_at timestamp, processed_at timestamp",
    "trademarks": """id string, gazette_id string, record_type string, application_number string, certificate_number string,
        madrid_number string, mark_category string, lineage_key string, submission_date date, publication_date date,
        registration_date date, vn_grant_date date, renewal_date date, expiry_date date, month int, year int,
        nice_classes array<string>, nice_group_number string, vienna_codes array<string>, mark_sample string, mark_name string,
        logo_path string, logo_phash string, logo_kind string, mark_embedding array<float>, is_representative boolean,
        applicant_name string, applicant_country_code string, applicant_city string, applicant_type string, ip_agency string,
        applicant_clean string, applicant_norm string, representative_clean string, representative_norm string""",
    "madrid_records": f"""irn string, holder_name string, holder_country string, mark_text string, representative string,
        registration_date date, expiration_date date, nice_classes array<string>, goods_services map<string,string>,
        designated_countries array<string>, vn_designated boolean, vn_status string, vn_grant_date date, vn_refusal_date date,
        designation_status map<string,struct<status:string,date:string,gazette:string>>, transaction_history array<{EVENT}>,
        content_hash string, parse_version int""",
    "domestic_records": """application_number string, mark_text string, mark_type string, applicant_name string, representative string,
        nice_classes array<string>, goods_services map<string,string>, vienna_codes array<string>, status_code string,
        filing_date date, publication_date date, grant_date date, expiry_date date,
        timeline array<struct<event:string,date:string,status:string>>, content_hash string, parse_version int""",
    "domestic_not_found": "application_number string, vnid string, first_seen_at timestamp, last_checked_at timestamp, check_count int",
    "tm_name_index": "application_number string, submission_date date, mark_sample string",
    "watchlists": """id string, name string, query struct<q:string,mode:string,threshold:double,country:string,nice_class:array<string>,
        nice_class_mode:string,record_type:string,applicant_type:string,ip_agency:string>, weights map<string,double>,
        total_count int, new_count int, owner_id string, last_run_at timestamp""",
}
