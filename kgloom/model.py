"""Schemas, as DDL, of the property graph and of what extraction, review and jobs exchange."""

CHAPTER = ("chapter_id string, title string, `order` bigint, description string")
KP = ("kp_id string, name string, chapter_id string, section string, aliases string, source string, source_book string, source_page int, source_pages string, "
             "category string, reviewed boolean, role string, level int, main_chain_order int, importance string")
EXAMPLE = ("example_id string, name string, chapter_id string, section string, scene string, difficulty string, target_kp_id string, source string, reviewed boolean")
EDGE = ("src string, dst string, type string, description string")
SECTION = ("chapter_id string, section string, title string, text string, code_blocks array<string>, char_count int, code_block_count int")
SEGMENT = ("section_id string, title string, text string, keywords array<string>, has_code boolean, char_count int, level int")
TRIPLE = ("subject_id string, subject_name string, predicate string, object_id string, object_name string, evidence string, source string, section_key string, "
                 "mapped_kp string, file_path string")
FUSED = ("subject_id string, subject_type string, subject_name string, predicate string, object_id string, object_type string, object_name string, source string, "
                "confidence double, section_key string, file_path string, pattern_name string, question string, evidence string")
GOLD = ("sample_id string, chapter_id string, section string, text_fragment string, question string, knowledge_points array<string>, "
               "relation_hints array<struct<type string, target string>>")
CANDIDATE = ("_section_key string, chapter_id string, section string, section_title string, name string, aliases string, category string, summary string, description string, "
                    "code_example string, source string, prerequisites array<string>, related array<string>, reviewed boolean, duplicate_of string, candidate_type string")
REVIEW = ("seq bigint, id string, type string, action string, data map<string,string>, status string, created_at string, source string")
JOB = ("seq bigint, job_id string, status string, filename string, message string, updated_at string")
PAGE = ("job_id string, page int, text string, source string")

#: Labels with data, and edge types with a writer.
LABELS = ["KnowledgePoint", "Chapter", "Example"]
EDGE_TYPES = ["CONTAINS", "PREREQUISITE", "RELATED", "EXTENDS", "EXAMPLE_OF", "FUSED_RELATION"]
