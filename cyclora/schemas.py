"""Declared schemas of the inputs. Nothing is inferred."""

from __future__ import annotations

FEATURE_HIT = """target_name string, target_accession string, tlen int, query_name string, query_accession string, qlen int, full_e_value double,
    full_score double, full_bias double, dom_idx int, dom_total int, dom_c_evalue double, dom_i_evalue double, dom_score double, dom_bias double,
    hmm_from int, hmm_to int, ali_from int, ali_to int, env_from int, env_to int, acc double, description string"""
ANNOTATION = "NUCCORE_ACC string, gene_symbol string, strand_orientation string, input_gene_start long, input_gene_stop long, antimicrobial_agent string"
SIMILARITY_HIT = "query_id string, subject_id string, pident double, length int, qlen int, slen int, evalue double, bitscore double, qcovs double"
MOTIF_HIT = "guide_id string, plasmid_id string, pident double, length int, mismatch int, qlen int, sstart int, send int, sstrand string"
NAME_TO_CLAN = "accession string, clan_accession string, clan_name string, domain_name string, description string"
GENE_MAP = "query_id string, gene_name string, gene_family string"
PREVALENCE = "Name string, `NCBI Plasmid` double, `NCBI WGS` double, `NCBI Chromosome` double"
CLUSTER = "plasmid string, cluster int, umap_x double, umap_y double"
EXCLUSION = "query_id string, start int, end int"
ONTOLOGY = """map<string, struct<ARO_accession: string, ARO_name: string, ARO_description: string, model_id: string, model_type: string,
    ARO_category: map<string, struct<category_aro_name: string, category_aro_class_name: string>>,
    model_sequences: struct<sequence: map<string, struct<protein_sequence: struct<accession: string, sequence: string>>>>>>"""
EDGE = "src string, dst string, orientation string, weight long"
