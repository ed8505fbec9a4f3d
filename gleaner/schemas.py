"""Schemas of the stored tables, for readers that must not infer them.

Null and blank: a chunk without module carries '' (core product); a null ``version_max`` is
still current; times of logs are ISO text, days are its first ten characters.
"""

DOC_META = ("doc_id string, doc_type string, module_id string, version_min double, version_max double, is_robot_doc boolean, "
            "ocr_needed boolean, format string, lang string, discard boolean, image_count int, source_file string")
CHUNK = ("doc_id string, chunk_index int, doc_type string, module_id string, version_min double, version_max double, is_robot_doc boolean, "
         "has_image_caption boolean, source_doc string, source_page int, source_section string, lang string, text string")
INDEXED_CHUNK = CHUNK + ", chunk_id string, embedding array<float>"
QUERY = ("query_id string, question string, tenant_id string, lang string, top_k int, generate boolean, reranker string, generation_model string, "
         "prior_turns array<struct<question:string,answer:string>>, embedding array<float>")
ANSWER_CHUNK = ("query_id string, rank int, chunk_id string, score double, source_doc string, source_page int, source_section string, "
                "has_image_caption boolean, text string")
FEEDBACK = "feedback_id string, timestamp string, query_id string, tenant_id string, rating string, stars int, reason string, correction string"
REVIEW = "feedback_id string, action string, notes string, timestamp string"
COST_EVENT = "event_id bigint, ts string, model string, provider string, units_in double, units_out double, estimated_cost double"
REQUEST = "client bigint, ts timestamp, event_id bigint, heavy boolean"
PAIR = ("question string, answer string, difficulty string, doc_type string, source_doc string, source_section string, source_page int, chunk_id string, "
        "has_image_source boolean, chunk_text_preview string, hard_neg_a string, hard_neg_b string, validator_confidence double, validated boolean")
SEGMENT = "recording_id string, seg_id bigint, start double, end double, speaker string, text string"
CALL_ANALYSIS = ("call_id string, source_file string, source_file_hash string, timestamp_start string, timestamp_end string, customer string, caller string, agent string, "
                 "problem string, description string, cause string, resolution string, resolved string, summary string, "
                 "rag_qa array<struct<question:string,answer:string,category:string,confidence:string>>, software_features array<string>, error_codes array<string>, "
                 "tags array<string>, transcript array<struct<start:string,end:string,speaker:string,text:string>>, processing_metadata map<string,string>")
INGEST_RUN = "timestamp string, docs_processed int, chunks_created int, errors array<string>"
